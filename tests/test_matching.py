"""Corpus-wide name/domain match against all pairs."""

import random
import re
from difflib import SequenceMatcher

import pytest

from orgcard.functions.names import EXCLUDED_LABELS
from orgcard.operators import matching


def plain(names, labels):
    out = {}
    for name in {n for n in names if n is not None}:
        clean = re.sub(r"[^\w\s]", "", name.lower())
        words = clean.split()
        for label in {x for x in labels if x} - set(EXCLUDED_LABELS):
            tests = ["".join(w[0] for w in words) == label, clean.replace(" ", "") == label,
                     any(len(w) > 2 and w in label for w in words), clean != "" and SequenceMatcher(None, clean, label).ratio() > 0.8]
            if any(tests):
                out[name, label] = matching.RULES[tests.index(True)]
    return out


def variant(r, s):
    s = list(s)
    for _ in range(r.randrange(4)):
        i = r.randrange(len(s) + 1)
        s[i:i + r.choice([0, 1])] = r.choice(["", "e", "x", "ab", "-"])
    return "".join(s) or "q"


@pytest.mark.parametrize("split", [3, 50_000])
def test_against_all_pairs(spark, monkeypatch, plan, split):
    monkeypatch.setattr(matching, "SPLIT", split)
    r = random.Random(5)
    stems = ["acme", "globex", "international business machines", "gooogle", "procter gamble", "ab", "banana", "aaaaaaa", "the boeing company", "initech labs", "x", "ee"]
    names = [" ".join(w.title() for w in variant(r, r.choice(stems)).split()) + r.choice(["", " Inc.", " & Co"]) for _ in range(150)]
    names += [None, "", "  ", "!!", "Amazon", "Acme", "Acme", "ACME widgets", "I B M", "É clair"]
    labels = [re.sub(r"\s", "", variant(r, r.choice(stems))) for _ in range(150)] + [None, "", "amazon", "ibm", "acme", "acme", "pg", "éclair"]
    frame = lambda rows, c: spark.createDataFrame([(x, 1) for x in rows], f"{c} string, n int")
    out = matching.match_domains(frame(names, "company_name"), frame(labels, "label"))
    assert "CartesianProduct" not in plan(out) and "NestedLoop" not in plan(out)
    got = {(x.company_name, x.label): x.rule for x in out.collect()}
    want = plain(names, labels)
    assert got == want
    assert {x for x in want.values()} == set(matching.RULES)


def test_empty_and_stop_words(spark):
    names = spark.createDataFrame([("The Boeing Company",)], "company_name string")
    labels = spark.createDataFrame([("thehill",), ("boeing",)], "label string")
    assert {x.label for x in matching.match_domains(names, labels, stop_words=["the"]).collect()} == {"boeing"}
    assert matching.match_domains(names.limit(0), labels).collect() == [] == matching.match_domains(names, labels.limit(0)).collect()
