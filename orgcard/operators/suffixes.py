"""Public suffixes by a caller's table of rules: the longest rule that a host ends in, wildcards and exceptions included.

A rule is a suffix (``co.uk``), a wildcard whose star stands for one label (``*.ck``), or an exception to one (``!www.ck``, whose
suffix is what follows its first label). Every host is listed once with all of its ends, the ends are joined to the rules, and an
exception comes before the longest rule. A host that no rule fits has its last label as suffix, a host that is a suffix itself
has no registrable label.

Results for special cases: null or hostless URLs have neither suffix nor label; numeric hosts are their own label; blank and null
rules are left out, equal ones count once; rules are compared in lower case without a dot in front.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orgcard.functions.urls import host
from orgcard.operators.storage import BROADCAST_ROWS


def suffix_rules(rules: DataFrame) -> DataFrame:
    """(rule, exact, wild, exception): where an end of a host has to be looked up."""
    rule = F.regexp_replace(F.lower(F.trim("suffix")), r"^\.", "")
    rules = rules.select(rule.alias("rule")).filter((F.col("rule") != "") & (F.col("rule") != "*")).distinct()
    kind = F.when(F.col("rule").startswith("!"), 2).when(F.col("rule").startswith("*."), 1).otherwise(0)
    return rules.select(F.regexp_replace("rule", r"^(?:!|\*\.)", "").alias("end"), kind.alias("kind"))


def host_suffixes(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, suffix_labels) of distinct hosts (host): how many labels its public suffix has."""
    looked_up = suffix_rules(rules)
    if looked_up.count() <= BROADCAST_ROWS:
        looked_up = F.broadcast(looked_up)
    labels = F.split("host", r"\.")
    n = F.size(labels)
    ends = hosts.select("host", F.explode(F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(
        k.alias("k"), F.array_join(F.slice(labels, n - k + 1, k), ".").alias("end"), (n > k).alias("longer")))).alias("e")).select("host", "e.*")
    # an exact rule covers its own labels, a wildcard one more, an exception one less and before all others
    covered = F.col("k") + F.when(F.col("kind") == 1, 1).when(F.col("kind") == 2, -1).otherwise(0)
    found = ends.join(looked_up, "end").filter((F.col("kind") != 1) | F.col("longer"))
    best = found.groupBy("host").agg(F.max(F.struct((F.col("kind") == 2).alias("exception"), covered.alias("labels"))).alias("best"))
    return hosts.join(best, "host", "left").select("host", F.coalesce("best.labels", F.lit(1)).alias("suffix_labels"))


def with_registrable_label(df: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``suffix`` and ``label``, the label left of the public suffix, by ``rules(suffix)``. Hosts are looked up once each."""
    keyed = df.withColumn("host", host(F.col(url)))
    names = keyed.select("host").filter(F.col("host").isNotNull() & ~F.col("host").rlike(r"^[0-9.]+$")).distinct()
    keyed = keyed.join(host_suffixes(names, rules), "host", "left")
    labels = F.split("host", r"\.")
    n, own = F.size(labels), F.col("suffix_labels")
    suffix = F.array_join(F.slice(labels, F.greatest(n - own + 1, F.lit(1)), F.greatest(own, F.lit(1))), ".")
    label = F.when(own.isNull(), F.col("host")).when(n > own, F.get(labels, n - own - 1))
    return keyed.select(*df.columns, F.when(own.isNotNull(), suffix).alias("suffix"), label.alias("label"))
