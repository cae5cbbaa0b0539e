"""Search of JSON documents whose shape is not known."""

from __future__ import annotations

import json as json_lib
from collections.abc import Callable, Iterator
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names under which a record's title may stand, first to last.
TITLE_NAMES = ("title", "program_title", "vod_title", "subject", "name")
MAX_DEPTH = 8


def mentions(text: Column, number: Column) -> Column:
    """Whether ``text`` holds ``number`` as a whole number, leading zeros allowed."""
    # The pattern differs by row, so it is only tried where the digits stand at all.
    return F.contains(text, number.cast("string")) & F.regexp_like(text, F.concat(F.lit(r"(?<![0-9])0*"), number.cast("string"), F.lit("(?![0-9])")))


def _strings(node: dict | list, names: tuple[str, ...], depth: int, at: tuple[int, ...] = (), path: str = "$") -> Iterator[tuple]:
    """(at, path, name, value) of the strings under ``names``, in the order of the document, an object before what it holds."""
    if isinstance(node, dict):
        yield from ((at, path, name, value) for name in names if isinstance(value := node.get(name), str))
    if depth:
        for i, (key, child) in enumerate(node.items() if isinstance(node, dict) else enumerate(node)):
            if isinstance(child, dict | list):
                step = f".{key}" if isinstance(node, dict) else f"[{key}]"
                yield from _strings(child, names, depth - 1, (*at, i), path + step)


_DECODER = json_lib.JSONDecoder(parse_int=float)  # numbers are not looked at, however long


def _said(text: str | None, names: tuple[str, ...], depth: int) -> list[tuple]:
    try:
        root, _ = _DECODER.raw_decode((text or "").lstrip(" \t\r\n"))
    except (ValueError, RecursionError):
        return []
    return list(_strings(root, names, depth)) if isinstance(root, dict | list) else []


def _texts(values: list[str]) -> pa.Array:
    # Halves of surrogate pairs are no text; the JVM makes them "?" too.
    return pa.array([v if v.isascii() else v.encode("utf-8", "replace").decode() for v in values], pa.string())


def _starts(sizes: list[int]) -> pa.Array:
    return pa.array([0, *accumulate(sizes)], pa.int32())


def _child(node: Column, i: Column) -> Column:
    """The i-th child of an object or array, both as (text, value).

    The text knows the order of an object's keys, which variants sort.
    """
    item = F.struct(F.get(F.from_json(node["text"], "array<string>"), i).alias("text"), F.get(F.try_variant_get(node["value"], "$", "array<variant>"), i).alias("value"))
    entry = F.get(F.map_entries(F.from_json(node["text"], "map<string,string>")), i)
    field = F.struct(entry["value"].alias("text"), F.try_element_at(F.try_variant_get(node["value"], "$", "map<string,variant>"), entry["key"]).alias("value"))
    return F.when(F.startswith(F.schema_of_variant(node["value"]), F.lit("ARRAY")), item).otherwise(field)


def first_node(
    rows: DataFrame,
    json: str,
    match: Callable[[Column], Column],
    names: tuple[str, ...] = TITLE_NAMES,
    depth: int = MAX_DEPTH,
    with_node: bool = True,
) -> DataFrame:
    """``rows`` with ``found`` (at, path, name, value, node): the first object with a matching string under one of ``names``.

    First in the order of the document, an object before what it holds; at most ``depth``
    levels below the root. ``match`` makes a condition of the string's column and may use the
    row's others. found is null where nothing matches or the text is no JSON (a repeated key in
    an object counts as none); node, the object as JSON, is left out on request. A row's strings
    are listed in its batch and matched within the row, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [_said(t, names, depth) for t in batch.column(batch.schema.get_field_index(json)).to_pylist()]
            flat = list(chain.from_iterable(lists))
            places, paths, keys, values = ([x[i] for x in flat] for i in range(4))
            at = pa.ListArray.from_arrays(_starts([len(p) for p in places]), pa.array(list(chain.from_iterable(places)), pa.int32()))
            each = pa.StructArray.from_arrays([at, _texts(paths), _texts(keys), _texts(values)], ["at", "path", "name", "value"])
            said = pa.ListArray.from_arrays(_starts([len(x) for x in lists]), each)
            yield pa.RecordBatch.from_arrays([*batch.columns, said], names=[*batch.schema.names, "__said"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    said = rows.mapInArrow(run, schema + ", `__said` array<struct<at: array<int>, path: string, name: string, value: string>>")
    first = F.get(F.filter("__said", lambda s: F.coalesce(match(s["value"]), F.lit(False))), F.lit(0))
    # What is JSON, the parser of variants decides.
    hit = F.when(F.try_parse_json(F.col(json)).isNotNull(), F.col("__first"))
    out = said.withColumn("__first", first).withColumn("__first", F.when(F.col("__first").isNotNull(), hit))
    fields = [F.col(f"__first.{f}").alias(f) for f in ("at", "path", "name", "value")]
    if with_node:
        root = F.struct(F.col(json).alias("text"), F.try_parse_json(F.col(json)).alias("value"))
        fields.append(F.to_json(F.aggregate("__first.at", root, _child)["value"]).alias("node"))
    kept = [F.col(c) for c in rows.columns]
    return out.select(*kept, F.when(F.col("__first").isNotNull(), F.struct(*fields)).alias("found"))


def first_of(rows: DataFrame, node: str, names: dict[str, tuple[str, ...]]) -> DataFrame:
    """``rows`` with a column for each of ``names``: the first of its keys that stands in the ``node`` (JSON) as a filled string."""
    parsed = F.try_parse_json(F.col(node))

    def pick(keys: tuple[str, ...]) -> Column:
        return F.coalesce(*(F.when(F.trim(v) != "", v) for v in (F.try_variant_get(parsed, f"$['{k}']", "string") for k in keys)))

    return rows.withColumns({column: pick(keys) for column, keys in names.items()})
