"""Element tree of a page as one array column.

``shred`` turns markup into an array of nodes; the selectors on it are plain column expressions,
so containment (``[id, end]`` intervals), class tests and precedence stay in Catalyst and no
shuffle is needed. The two Arrow functions here and the name ratio are the only Python steps.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from orgcard.functions.text import WIDE_BLANK_CODES, let

# Executors get the functions of this module by value: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# --- fixed values ---------------------------------------------------------------------------
VOID_TAGS = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
# --- end of fixed values --------------------------------------------------------------------
# Pages whose trees are held and handed back at a time.
PAGES = 64
# Wide blanks become plain ones here as in visible_text, so that offsets stay equal.
_BLANKS = dict.fromkeys(WIDE_BLANK_CODES, " ")
RAW_TAGS = {"script": "#script", "style": "#script", "template": "#script"}
ATTRIBUTES = [
    "class", "href", "src", "name", "content", "type", "itemtype", "itemprop",
    "data-email", "data-phone",
]
_INTS = ["id", "end", "parent", "depth", "t0", "t1"]
_STRINGS = ["tag", "text"] + [a.replace("-", "_") for a in ATTRIBUTES]

NODE_TYPE = StructType(
    [StructField(n, IntegerType()) for n in _INTS] + [StructField(n, StringType()) for n in _STRINGS]
)
TREE_TYPE = StructType(
    [
        StructField("nodes", ArrayType(NODE_TYPE)),
        StructField("text", StringType()),
        StructField("error", StringType()),
    ]
)
LEAF_TYPE = StructType(
    [
        StructField("script_ord", IntegerType()),
        StructField("leaf_ord", IntegerType()),
        StructField("path", StringType()),
        StructField("key", StringType()),
        StructField("value", StringType()),
    ]
)
_NODE_ARROW = pa.struct([(n, pa.int32()) for n in _INTS] + [(n, pa.string()) for n in _STRINGS])
_LEAF_ARROW = pa.struct(
    [("script_ord", pa.int32()), ("leaf_ord", pa.int32())]
    + [(n, pa.string()) for n in ("path", "key", "value")]
)


class _Shredder(HTMLParser):
    """Void tags close at once, an end tag closes up to the nearest open tag of its name."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[dict] = []
        self.open: list[dict] = []
        self.pieces: list[str] = []
        self.length = 0
        self.pending: list[str] = []

    def _add(self, tag: str, **fields) -> dict:
        parent = self.open[-1] if self.open else None
        node = {
            "id": len(self.nodes), "end": len(self.nodes), "tag": tag, "text": None,
            "parent": parent["id"] if parent else None, "depth": len(self.open),
            "t0": self.length, "t1": self.length, "children": 0, "only": None, **fields,
        }
        self.nodes.append(node)
        self._adopt(node)
        return node

    def _adopt(self, child: dict | None) -> None:
        if self.open:
            self.open[-1]["children"] += 1
            self.open[-1]["only"] = child

    def _write(self, piece: str) -> None:
        # Offsets count code points, as substring does in Spark.
        self.pieces.append(piece)
        self.length += len(piece)

    def _flush(self) -> None:
        if not self.pending:
            return
        data = "".join(self.pending).translate(_BLANKS)
        self.pending = []
        raw = RAW_TAGS.get(self.open[-1]["tag"]) if self.open else None
        if data.strip():
            node = self._add(raw or "#text", text=data)
        else:
            node = None
            self._adopt(None)
        if raw is None:
            self._write(data)
            if node:
                node["t1"] = self.length

    def _close(self, node: dict) -> None:
        node["end"] = len(self.nodes) - 1
        node["t1"] = self.length
        if node["children"] == 1 and node["only"] is not None:
            node["text"] = node["only"]["text"]

    def handle_starttag(self, tag, attrs):
        self._flush()
        self._write(" ")
        wanted = {k.replace("-", "_"): v or "" for k, v in reversed(attrs) if k in ATTRIBUTES}
        node = self._add(tag, **wanted)
        if tag not in VOID_TAGS:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self._close(self.open.pop())

    def handle_endtag(self, tag):
        self._flush()
        if any(n["tag"] == tag for n in self.open):
            while True:
                node = self.open.pop()
                self._close(node)
                if node["tag"] == tag:
                    break
        self._write(" ")

    def handle_data(self, data):
        self.pending.append(data)

    def handle_comment(self, data):
        self._flush()
        self._add("#comment", text=data)

    def finish(self) -> None:
        self.close()
        self._flush()
        while self.open:
            self._close(self.open.pop())


def _nodes_to_arrow(pages: list[list[dict] | None]) -> pa.ListArray:
    offsets, flat = [0], []
    for nodes in pages:
        flat.extend(nodes or [])
        offsets.append(len(flat))
    columns = [pa.array([n[f] for n in flat], pa.int32()) for f in _INTS]
    columns += [pa.array([n.get(f) for n in flat], pa.string()) for f in _STRINGS]
    values = pa.StructArray.from_arrays(columns, fields=list(_NODE_ARROW))
    return pa.ListArray.from_arrays(
        pa.array(offsets, pa.int32()), values, mask=pa.array([p is None for p in pages])
    )


def _shredded(pages: list[str | None]) -> pa.StructArray:
    nodes, texts, errors = [], [], []
    for markup in pages:
        if markup is None:
            nodes.append(None), texts.append(None), errors.append(None)
            continue
        parser, error = _Shredder(), None
        try:
            parser.feed(markup)
            parser.finish()
        except (AssertionError, ValueError) as e:  # a broken page yields what was read so far
            error = str(e)
            while parser.open:
                parser._close(parser.open.pop())
        nodes.append(parser.nodes), texts.append("".join(parser.pieces)), errors.append(error)
    return pa.StructArray.from_arrays(
        [_nodes_to_arrow(nodes), pa.array(texts, pa.string()), pa.array(errors, pa.string())],
        names=["nodes", "text", "error"],
    )


@F.arrow_udf(TREE_TYPE)
def _shred(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    # a worker holds the trees of a few pages, however many it is handed at a time
    for html in batches:
        for at in range(0, len(html), PAGES):
            yield _shredded(html.slice(at, PAGES).to_pylist())


def _leaves(doc, path: str, out: list) -> None:
    if isinstance(doc, dict):
        for key, value in doc.items():
            here = f"{path}.{key}"
            if isinstance(value, str):
                out.append((here, key, value))
            else:
                _leaves(value, here, out)
    elif isinstance(doc, list):
        for i, item in enumerate(doc):
            if isinstance(item, (dict, list)):
                _leaves(item, f"{path}[{i}]", out)


@F.arrow_udf(ArrayType(LEAF_TYPE))
def _json_leaves(objects: pa.Array) -> pa.Array:
    result = []
    for page in objects.to_pylist():
        if page is None:
            result.append(None)
            continue
        rows = []
        for ord_, text in enumerate(page):
            found: list = []
            try:
                _leaves(json.loads(text), "$", found)
            except (ValueError, RecursionError):
                continue
            rows += [
                {"script_ord": ord_, "leaf_ord": i, "path": p, "key": k, "value": v}
                for i, (p, k, v) in enumerate(found)
            ]
        result.append(rows)
    return pa.array(result, pa.list_(_LEAF_ARROW))


def shred(html: Column) -> Column:
    """Struct of ``nodes``, ``text`` (a blank per tag; ``t0``/``t1`` of a node index it), ``error``."""
    return _shred(html)


def json_leaves(objects: Column) -> Column:
    """String members of JSON objects in document order (a VARIANT would sort the keys)."""
    return _json_leaves(F.when(F.size(objects) > 0, objects))


# --- selectors ------------------------------------------------------------------------------


def inside(node: Column, area: Column) -> Column:
    """The node is a descendant of the area."""
    return (node["id"] > area["id"]) & (node["id"] <= area["end"])


def has_class(node: Column, name: str) -> Column:
    # most classes are told apart without splitting them
    return F.contains(node["class"], F.lit(name)) & F.array_contains(F.split(node["class"], r"\s+"), name)


def class_like(node: Column, pattern: str) -> Column:
    return F.coalesce(node["class"].rlike(pattern), F.lit(False))


def is_element(node: Column) -> Column:
    return ~node["tag"].startswith("#")


def subtree_text(node: Column, text: Column) -> Column:
    return F.substring(text, node["t0"] + 1, node["t1"] - node["t0"])


def outermost(areas: Column) -> Column:
    """Areas that lie in no other area of the array."""
    return let(
        areas, lambda all_: F.filter(all_, lambda a: ~F.exists(all_, lambda b: inside(a, b)))
    )


def descendants(nodes: Column, area: Column, with_self: bool = False) -> Column:
    """Nodes inside an area in document order: ids are positions, so this is a slice."""
    start, length = area["id"] + 2, area["end"] - area["id"]
    if with_self:
        start, length = area["id"] + 1, length + 1
    return F.slice(nodes, start, length)
