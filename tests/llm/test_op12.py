"""Filter audit: every order applied plainly to every row."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from orgcard.llm import filteraudit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, source string, quality int, n string, mask int, part int, key int"


def letters_of(text, key, rows):
    words = WORD.findall(text)
    return "".join(x for x, bad in {
        "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search(r"[#$%&*|]", text)),
        "E": key is not None and any(k is not None and k < key and (t or "") == text for k, t, *_ in rows)}.items() if bad)


def plain(rows, labels):
    good, toxic = ({k for k, *flags in labels if flags[i] == 1} for i in (0, 1))
    failing = [(s or "", k, letters_of(t or "", k, rows)) for k, t, s, *_ in rows]
    out, shapley = {}, Counter()
    for part in {p for p, *_ in failing}:
        own = [x for x in failing if x[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                now = [x for x in left if f in x[2]]
                fails = sum(f in x[2] for x in own)
                left = [x for x in left if f not in x[2]]
                shapley[part, f] += len(now)
                out[part, order, step] = [len(left), len(now), fails - len(now), sum(x[2] == f for x in own),
                                          sum(x[1] in good for x in now), sum(x[1] in toxic for x in now)]
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def text_of(r):
    words = r.choice([["ab", "cd", "Ef"], [f"w{i}" for i in range(300)], ["QQ"]])
    return r.choice(["", " ", "\t"]).join(["", r.choice(["", "$ ", "ü" * 40])]) + " ".join(r.choice(words) for _ in range(r.choice([0, 1, 150, 199, 200, 260])))


def test_against_every_order(spark):
    r = random.Random(4)
    texts = [text_of(r) for _ in range(25)]
    rows = [(r.choice([None, *range(40)]), r.choice([None, "", *texts]), r.choice([None, "", "a", "b"]), 1, "x", 3, 4, 5) for _ in range(160)]
    labels = [(r.choice([None, *range(40)]), r.choice([None, 0, 1]), r.choice([None, 0, 1])) for _ in range(50)]
    out = filteraudit.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in out.collect()}
    assert got == plain(rows, [x for x in labels if x[0] is not None])
    assert len(got) == 3 * 600


@pytest.mark.parametrize("n", [1, 3, 5])
def test_removals_cover_each_order_once(n):
    """Prefix sums of a mask's differences are one step of removal in every order."""
    letters, orders = "ABCDE"[:n], list(permutations(range(n)))
    ends = filteraudit.removals(letters)
    for mask in range(1, 1 << n):
        for rank, order in enumerate(orders):
            step = next(i for i, f in enumerate(order, 1) if mask >> f & 1)
            assert [sum(e for m, s, k, e in ends if m == mask and s == i and k <= rank) for i in range(1, n + 1)] == [int(i == step) for i in range(1, n + 1)]


def test_own_filters_and_special_cases(spark):
    docs = spark.createDataFrame([(1, "a", "s", 1, "n", 1, 1, 1), (1, "a", "s", 1, "n", 1, 1, 1), (2, "a" * 400_000, None, 1, "n", 1, 1, 1)], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = filteraudit.audit(docs, labels, {"X": F.length("text") > 9, "Y": F.lit(None).cast("boolean")}, repeat=None, part=F.lit("all"))
    got = {(x.filter_order, x.step): (x.kept, x.removed) for x in out.collect()}
    assert got == {("XY", 1): (2, 1), ("XY", 2): (2, 0), ("YX", 1): (3, 0), ("YX", 2): (2, 1)}
    assert filteraudit.audit(docs.limit(0), labels).collect() == []
    assert {x.removed for x in filteraudit.audit(docs, labels).where("filter = 'E'").collect()} == {0}  # equal ids do not fail for each other
    with pytest.raises(ValueError):
        filteraudit.interactions(spark.createDataFrame([], "part string, mask int, n long, good long, toxic long"), "ABCDEFGH")
