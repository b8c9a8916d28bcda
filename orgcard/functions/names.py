"""Company name expressions and the name/domain match."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from orgcard.functions.text import blank_to_null

# --- fixed values ---------------------------------------------------------------------------
EXCLUDED_LABELS = [
    "facebook", "linkedin", "twitter", "instagram", "youtube",
    "amazon", "wikipedia", "bloomberg", "crunchbase",
]
MIN_SIMILARITY = 0.8
# --- end of fixed values --------------------------------------------------------------------


def clean_name(name: Column) -> Column:
    """Lower case without punctuation."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}_\s]", "")


def tokens(name: Column) -> Column:
    return F.filter(F.split(clean_name(name), r"\s+"), lambda w: w != "")


def initials(name: Column) -> Column:
    return F.array_join(F.transform(tokens(name), lambda w: F.substring(w, 1, 1)), "")


def squeezed(name: Column) -> Column:
    return F.replace(clean_name(name), F.lit(" "), F.lit(""))


def word_in_label(name: Column, label: Column, stop_words: list[str] | None = None) -> Column:
    """A word of three letters or more occurs in the label."""
    words = F.filter(tokens(name), lambda w: F.length(w) > 2)
    if stop_words:
        words = F.filter(words, lambda w: ~w.isin(stop_words))
    return F.exists(words, lambda w: F.contains(label, w))


@F.arrow_udf(DoubleType())
def _matching_ratio(a: pa.Array, b: pa.Array) -> pa.Array:
    """Ratcliff-Obershelp ratio: no built-in function computes it."""
    return pa.array(
        [
            None if x is None or y is None else SequenceMatcher(None, x, y).ratio()
            for x, y in zip(a.to_pylist(), b.to_pylist())
        ],
        pa.float64(),
    )


def similarity(name: Column, label: Column, wanted: Column | None = None) -> Column:
    """Ratio of matching characters; NULL where the lengths alone rule the threshold out.

    The bound is the ratio if the shorter string were wholly contained, so only pairs that can
    pass travel to Python.
    """
    a = blank_to_null(clean_name(name))
    la, lb = F.length(a), F.length(label)
    possible = 2 * F.least(la, lb) > MIN_SIMILARITY * (la + lb)
    if wanted is not None:
        possible = possible & wanted
    return _matching_ratio(F.when(possible, a), F.when(possible, label))


def matches_label_exactly(name: Column, label: Column, stop_words: list[str] | None = None) -> Column:
    """The three cheap rules: word in label, initials, squeezed name."""
    return F.coalesce(
        ~label.isin(EXCLUDED_LABELS)
        & (
            word_in_label(name, label, stop_words)
            | (initials(name) == label)
            | (squeezed(name) == label)
        ),
        F.lit(False),
    )
