"""Flat tables out of deeply nested records, by Arrow buffers.

Spark hands whole column batches over as Arrow. Every list found in a nested column is opened by its offsets: the parent
index of each element comes from the offsets (``list_parent_indices``), its place in the list from the distance to its
list's offset, and the keys of the ancestors are brought along by a vectorised ``take``. No row is looked at. Text columns
that hold JSON are decoded text by text into Python objects first, once, and then leave as flat arrays too.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class Level:
    """A list of objects at ``path`` below its parent's object, giving rows of ``kind``; ``inner`` are lists inside."""

    kind: str
    path: tuple[str, ...]
    inner: tuple[Level, ...] = field(default=())

    def kinds(self) -> list[str]:
        return [self.kind, *(k for x in self.inner for k in x.kinds())]


def _reach(node: pa.Array, path: tuple[str, ...]) -> pa.Array:
    for name in path:
        node = pc.struct_field(node, name)  # carries the parents' nulls along
    return node


def _open(node: pa.Array, level: Level, key: pa.Array, up: pa.Array) -> Iterator[tuple[str, pa.Array, pa.Array, pa.Array, pa.Array]]:
    lists = _reach(node, level.path)
    parent = pc.list_parent_indices(lists)
    items = pc.list_flatten(lists)
    if not len(items):
        return
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    first = np.cumsum(lengths) - lengths
    pos = np.arange(len(items), dtype=np.int64) - first[parent.to_numpy(zero_copy_only=False)]
    there = items.is_valid()  # a null element keeps its place but is no object
    items, parent, pos = items.filter(there), parent.filter(there), pa.array(pos, pa.int32()).filter(there)
    key, above = key.take(parent), up.take(parent)
    yield level.kind, key, above, pos, items
    for x in level.inner:
        yield from _open(items, x, key, pos)


def _attributes(items: pa.Array) -> pa.Array:
    """The scalar fields of the objects as one array of JSON-free maps: name to text."""
    plain = [f for f in items.type if not pa.types.is_nested(f.type)]
    n = len(items)
    if not plain:
        return pa.array([[]] * n, pa.map_(pa.string(), pa.string()))
    values = [pc.cast(pc.struct_field(items, f.name), pa.string()) for f in plain]
    # interleave the columns: element i * k + j is field j of object i
    order = np.arange(n * len(plain)).reshape(len(plain), n).T.ravel()
    flat = pa.concat_arrays(values).take(pa.array(order))
    names = pa.array([f.name for f in plain]).take(pa.array(np.tile(np.arange(len(plain)), n)))
    offsets = pa.array(np.arange(n + 1) * len(plain), pa.int32())
    return pa.MapArray.from_arrays(offsets, names, flat)


_MAP = pa.map_(pa.string(), pa.string())
OUT = "key long, kind string, parent_pos int, pos int, attributes map<string,string>"


def _batch(key: pa.Array, kind: str, above: pa.Array, pos: pa.Array, attributes: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [key, pa.array([kind]).take(pa.array(np.zeros(len(key), np.int64))), above, pos, attributes],
        names=["key", "kind", "parent_pos", "pos", "attributes"],
    )


def _present(node: T.DataType, level: Level) -> bool:
    for name in level.path:
        if not isinstance(node, T.StructType) or name not in node.names:
            return False
        node = node[name].dataType
    return isinstance(node, T.ArrayType) and isinstance(node.elementType, T.StructType)


def _pruned(node: T.DataType, level: Level) -> Level | None:
    """``level`` without the parts the schema lacks: optional fields may be absent from a whole table."""
    if not _present(node, level):
        return None
    for name in level.path:
        node = node[name].dataType
    kept = tuple(x for y in level.inner if (x := _pruned(node.elementType, y)))
    return Level(level.kind, level.path, kept)


def flatten_nested(df: DataFrame, key: str, column: str, levels: list[Level], attributes: bool = True) -> DataFrame:
    """One row per object in a list of the struct ``column``: ``(key, kind, parent_pos, pos, attributes)``.

    ``pos`` is the object's place in its list from 0; ``parent_pos`` its parent object's place, -1 at the top. Null lists and
    structs give nothing, a null element gives no row but keeps its place, an empty object is an object. ``attributes`` holds
    the object's scalar fields as text, and is null if they are not asked for. Levels that the schema lacks give nothing; an empty table gives an empty result.
    """
    schema = df.schema[column].dataType
    levels = [x for y in levels if (x := _pruned(schema, y))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, node = b.column(0), b.column(1)
            top = pa.array(np.full(len(keys), -1), pa.int32())
            for level in levels:
                for kind, k, above, pos, items in _open(node, level, keys, top):
                    yield _batch(k, kind, above, pos, _attributes(items) if attributes else pa.nulls(len(items), _MAP))

    return df.select(df[key].cast("long").alias("key"), df[column].alias("node")).mapInArrow(run, OUT)


def _object(text: str) -> dict[str, Any] | None:
    """The object that all of ``text`` spells, also where the JSON itself was delivered as a JSON string; else None."""
    while True:  # every decoding takes two quotes away at least
        try:
            value = json.loads(text)
        except (ValueError, RecursionError):
            return None
        if not isinstance(value, str):
            return value if isinstance(value, dict) else None
        text = value


def _listed(value: Any) -> list[Any]:
    """A list as it is; a lone object stands for a list of one; anything else is no list."""
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []


def _walk(node: dict[str, Any], level: Level, key: int, above: int, out: list[tuple[int, str, int, int, list[tuple[str, str | None]]]]) -> None:
    at: Any = node
    for name in level.path:
        at = at.get(name) if isinstance(at, dict) else None
    for pos, x in enumerate(_listed(at)):
        if isinstance(x, dict):
            plain = [(k, v if isinstance(v, str) or v is None else json.dumps(v)) for k, v in x.items() if not isinstance(v, dict | list)]
            out.append((key, level.kind, above, pos, plain))
            for y in level.inner:
                _walk(x, y, key, pos, out)


def flatten_json(df: DataFrame, key: str, column: str, levels: list[Level]) -> DataFrame:
    """As :func:`flatten_nested` for a text ``column`` holding JSON that need not follow one schema.

    A text counts only if an object can be read from all of it; a cut-off one, null, a number or a list gives nothing. A
    lone object stands for a list of one. Elements that are no objects keep their place but give no row.
    """
    types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.map_(pa.string(), pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple[int, str, int, int, list[tuple[str, str | None]]]] = []
            maybe = pc.fill_null(pc.match_substring(b.column(1), "{"), False)
            for k, text in zip(b.column(0).filter(maybe).to_pylist(), b.column(1).filter(maybe).to_pylist(), strict=True):
                if (o := _object(text)) is not None:
                    for level in levels:
                        _walk(o, level, k, -1, out)
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["key", "kind", "parent_pos", "pos", "attributes"]
            )

    return df.select(df[key].cast("long").alias("key"), df[column].alias("text")).mapInArrow(run, OUT)


def flat_table(objects: DataFrame, kind: str, fields: dict[str, str]) -> DataFrame:
    """The objects of one kind as a typed table: key, parent_pos, pos and ``fields`` (name to SQL type; unreadable is null)."""
    cols = [objects["attributes"][name].try_cast(t).alias(name) for name, t in fields.items()]
    return objects.where(objects["kind"] == kind).select("key", "parent_pos", "pos", *cols)


# Where the lists of a forum post stand.
MEDIA = [
    Level("thumbnail", ("oembed", "thumbnails")),
    Level("rendition", ("hosted_video", "renditions"), (Level("track", ("tracks",)),)),
    Level("gallery_item", ("gallery",), (Level("variant", ("variants",)),)),
]
EMBED = [Level("source", ("sources",), (Level("size", ("sizes",)),))]


def post_objects(posts: DataFrame, key: str = "line_no", attributes: bool = True) -> DataFrame:
    """Every object in a list of a post's ``media`` and ``secure_media_embed``."""
    return flatten_nested(posts, key, "media", MEDIA, attributes).unionAll(flatten_json(posts, key, "secure_media_embed", EMBED))
