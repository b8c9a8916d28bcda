"""Company names matched to domain labels over whole tables, without search hits: a theta join by blocking.

A name fits a label if a word of three letters or more occurs in it, if its initials or its squeezed form are the label, or if the
two are similar enough. The equalities are joins. For words, every label is listed under its trigrams, and a
word looks only at the list of its rarest trigram; a word with a trigram that no label has looks at none. For similarity, both
sides are listed under the rarest of their bigrams only (prefix filter), with bounds on the lengths and on the common
bigrams before the ratio is computed. Lists longer than SPLIT are dealt over several tasks.

Why no similar pair is lost: with S the sum of the lengths and M the matching characters, a ratio 2 M / S above 0.8 means M > 0.4 S.
Matching blocks are parted by characters without a match, of which there are S - 2 M < 0.2 S, so there are at most 0.2 S + 1 of them,
and the bigrams inside blocks, which both strings have, are more than 0.2 S - 1.

Results for special cases: null names and labels match nothing, names without letters or digits neither; equal rows are one;
excluded labels are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orgcard.functions import names as N

SPLIT = 50_000  # labels of one list that one task looks at
RULES = ["initials", "squeezed", "word", "similar"]
MIN_WORD = 3


def _grams(text: Column, n: int) -> Column:
    """Distinct substrings of n characters."""
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1)))
    return F.array_distinct(F.coalesce(F.transform(places, lambda i: F.substring(text, i, F.lit(n))), F.array().cast("array<string>")))


def _bigrams(text: Column) -> Column:
    """Bigrams with their number among equal ones, so that their multisets are sets."""
    places = F.when(F.length(text) >= 2, F.sequence(F.lit(1), F.length(text) - 1))
    all_ = F.coalesce(F.transform(places, lambda i: F.substring(text, i, F.lit(2))), F.array().cast("array<string>"))
    return F.transform(all_, lambda g, i: F.concat(g, F.size(F.filter(F.slice(all_, F.lit(1), i), lambda h: h == g)).cast("string")))


def _dealt(lists: DataFrame, askers: DataFrame, key: str, by: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join on ``key`` with a column ``part``: long lists are dealt by a hash of ``by``, and each asker
    of such a list asks all of its parts. ``lists`` has the length of its list in ``n``."""
    parts = F.ceil(F.col("n") / SPLIT).cast("int")
    lists = lists.withColumn("part", F.pmod(F.xxhash64(by), parts).cast("int")).drop("n")
    return lists, askers.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")


def word_pairs(words: DataFrame, labels: DataFrame) -> DataFrame:
    """(word, label) with the word inside the label, of distinct words and labels."""
    lists = labels.select("label", F.explode(_grams(F.col("label"), MIN_WORD)).alias("gram"))
    lengths = lists.groupBy("gram").agg(F.count("*").alias("n"))
    asked = words.select("word", F.explode(_grams(F.col("word"), MIN_WORD)).alias("gram")).join(lengths, "gram", "left")
    rarest = asked.groupBy("word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("r"))
    askers = rarest.filter("r.n > 0").select("word", "r.gram", "r.n")
    lists, askers = _dealt(lists.join(lengths, "gram"), askers, "gram", "label")
    return askers.join(lists, ["gram", "part"]).filter(F.contains("label", F.col("word"))).select("word", "label")


def _prefixes(texts: DataFrame, column: str, counts: DataFrame) -> DataFrame:
    """(column, size, gram, n) of the rarest bigrams of each text, as many as a partner must share one of."""
    size = F.length(column)
    # the shortest partner has just over 2/3 of the length; see the module's docstring for the bound
    least_sum = size + F.floor(size * 2 / 3) + 1
    must = F.greatest(F.floor(0.2 * least_sum - 1) + 1, F.lit(1))
    each = texts.select(column, size.alias("size"), F.explode(_bigrams(F.col(column))).alias("gram"), must.alias("must"))
    each = each.join(counts, "gram")
    ordered = each.groupBy(column, "size", "must").agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("g"))  # a text's own
    kept = F.slice("g", F.lit(1), F.greatest(F.size("g") - F.col("must") + 1, F.lit(0)).cast("int"))
    return ordered.select(column, "size", F.inline(kept))


def similar_pairs(names: DataFrame, labels: DataFrame) -> DataFrame:
    """(clean, label) of distinct cleaned names and labels whose ratio is above the threshold."""
    both = names.select(F.col("clean").alias("t")).unionByName(labels.select(F.col("label").alias("t")))
    # one order of bigrams for both sides; the length of the label lists decides how they are dealt
    counts = both.select(F.explode(_bigrams(F.col("t"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    lists, askers = _dealt(_prefixes(labels, "label", counts), _prefixes(names, "clean", counts), "gram", "label")
    near = askers.withColumnRenamed("size", "a").join(lists.withColumnRenamed("size", "b"), ["gram", "part"])
    near = near.filter(2 * F.least("a", "b") > N.MIN_SIMILARITY * (F.col("a") + F.col("b"))).select("clean", "label").distinct()
    common = F.size(F.array_intersect(_bigrams(F.col("clean")), _bigrams(F.col("label"))))
    near = near.filter(common > 0.2 * (F.length("clean") + F.length("label")) - 1 - 1e-9)
    ratio = N.similarity(F.col("clean"), F.col("label"))
    return near.withColumn("ratio", ratio).filter(F.col("ratio") > N.MIN_SIMILARITY).select("clean", "label")


def match_domains(
    names: DataFrame, labels: DataFrame, stop_words: list[str] | None = None, similar: bool = True,
) -> DataFrame:
    """(company_name, label, rule) of all pairs of names (company_name) and domain labels (label) that fit, with the first of
    RULES that holds. ``stop_words`` are no words of a name; ``similar=False`` leaves the ratio out."""
    name = F.col("company_name")
    names = names.filter(name.isNotNull()).select("company_name").distinct().select(
        "company_name", N.clean_name(name).alias("clean"), N.initials(name).alias("initials"), N.squeezed(name).alias("squeezed"))
    labels = labels.filter(F.col("label").isNotNull() & (F.col("label") != "") & ~F.col("label").isin(N.EXCLUDED_LABELS)).select("label").distinct()

    def equal(rule: int, key: str) -> DataFrame:
        return names.select("company_name", F.col(key).alias("label")).join(labels, "label").select("company_name", "label", F.lit(rule).alias("rule"))

    words = names.select("company_name", F.explode(F.array_distinct(N.tokens(name))).alias("word")).filter(F.length("word") >= MIN_WORD)
    if stop_words:
        words = words.filter(~F.col("word").isin(stop_words))
    inside = word_pairs(words.select("word").distinct(), labels)
    pairs = equal(0, "initials").unionByName(equal(1, "squeezed")).unionByName(
        words.join(inside, "word").select("company_name", "label", F.lit(2).alias("rule")))
    if similar:
        close = similar_pairs(names.filter(F.col("clean") != "").select("clean").distinct(), labels)
        pairs = pairs.unionByName(names.select("company_name", "clean").join(close, "clean").select("company_name", "label", F.lit(3).alias("rule")))
    first = pairs.groupBy("company_name", "label").agg(F.min("rule").alias("rule"))
    return first.select("company_name", "label", F.get(F.array(*map(F.lit, RULES)), F.col("rule")).alias("rule"))
