"""Deeply nested JSON documents as related flat tables, by Dewey labelling.

Each node of a document gets a Dewey label, the ordinals on the way from the
root to it: the place in a list, or the place of a field in its object. The
label's text twin, the path, holds positions and field names instead. Nodes that
share a schema path (the path with ``[]`` for positions and ``*`` for open-ended
names) make up one table. A node's parent is the nearest node above it that has a
row, so parent links need no look-up at all: they are the node's own label without
its last components, as many as the schema paths of the two tables differ by.

``shred`` takes the schema paths wanted, ``shred_all`` finds them by itself: every
object and every item of a list that holds objects or lists gets a row, with its
plain values as its fields; ``schema_paths`` reports the tables found.

JSON of unknown shape is read in Python, one pass over Arrow batches, because
documents carry NaN literals, are wrapped as JSON strings, and write their lists
in several ways; everything after the labels stays in the JVM.

Lists count in whatever form they are written: a plain list, an object whose
keys are all integers (the keys are the places), a JSON text of either, or a
lone value (place 0). A blank text, null and an absent field are no list. Items
that are null take a place and yield no row; NaN is a value. A document that
can't be parsed to an object (null, blank, cut off) yields no row. Rows with
equal ids each count. A table without rows gives tables without rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bipartiq.session import ship, slices

#: Documents that a step works on at once, and rows in one batch of the result.
DOCS_AT_ONCE = 256
ROWS_PER_BATCH = 20_000

NODES = "{id} {id_type}, dewey array<int>, path string, schema_path string, pos int, fields string"


def parse_document(text: str | None) -> dict | None:
    """The object that a body holds, in however many layers, or None if it holds none or is cut off."""
    value: object = text
    while True:  # each layer taken off leaves less
        if isinstance(value, dict):
            return value
        if isinstance(value, list) and len(value) == 1:
            value = value[0]
        elif isinstance(value, str):
            try:
                value = json.loads(value.strip().lstrip("﻿").strip())
            except (ValueError, RecursionError):
                return None
        else:
            return None


def decoded(value: object) -> object:
    """A value that may be written as JSON text; other texts stay as they are."""
    while isinstance(value, str) and value.strip():
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            break
    return value


def list_items(value: object) -> list[tuple[int, object]]:
    """Places and items of a list, in whatever form it is written."""
    value = decoded(value)
    if value is None or isinstance(value, str) and not value.strip():
        return []
    if isinstance(value, list):
        return list(enumerate(value))
    if isinstance(value, dict):
        try:
            return sorted(((int(k), x) for k, x in value.items()), key=lambda item: item[0])
        except ValueError:
            return [(0, value)]
    return [(0, value)]


def _grow(patterns: list[str]) -> dict:
    """Patterns as a tree of steps; a step that ends a pattern holds the key ''."""
    tree: dict = {}
    for pattern in patterns:
        at = tree
        for step in pattern.replace("[]", "/[]").split("/"):
            at = at.setdefault(step, {})
        at[""] = pattern
    return tree


def _finite(value: object) -> object:
    """A value with NaN and infinities as texts, which Spark can read and cast to double."""
    if isinstance(value, float) and not math.isfinite(value):
        return "NaN" if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    if isinstance(value, dict):
        return {k: _finite(v) for k, v in value.items()}
    return [_finite(v) for v in value] if isinstance(value, list) else value


def _json(item: object) -> str:
    """A value as JSON. Within an object or list NaN and infinities become texts: get_json_object
    gives null for every path of an object that holds such a literal. A lone
    number isn't read by path and stays as it is.
    """
    try:
        return json.dumps(item, ensure_ascii=False, allow_nan=not isinstance(item, (dict, list)))
    except ValueError:
        return json.dumps(_finite(item), ensure_ascii=False)


def _pruned(item: object, below: dict) -> object:
    """An item's own values, without the parts that have tables of their own."""
    if not isinstance(item, dict) or not any(below):
        return item
    kept = {}
    for name, value in item.items():
        part = below.get(name, below.get("*", {}))
        if "" in part or "[]" in part:
            continue
        kept[name] = _pruned(value, part) if part else value
    return kept


def label_nodes(document: dict, patterns: list[str], with_fields: bool = True) -> Iterator[tuple]:
    """(dewey, path, pattern, place, own fields) of each list item or object under one of the patterns."""
    stack: list[tuple] = [(document, _grow(patterns), (), ())]
    while stack:
        node, steps, dewey, path = stack.pop()
        for step, below in steps.items():
            if step == "":
                continue
            if step == "[]":
                for place, item in list_items(node):
                    if item is None:
                        continue
                    here, label = (*dewey, place), (*path, str(place))
                    if "" in below:
                        own = decoded(item) if any(below) else item
                        yield here, "/".join(label), below[""], place, _json(_pruned(own, below)) if with_fields else None
                    if any(below):
                        stack.append((item, below, here, label))
                continue
            at = decoded(node)
            if step == "*":
                names = list(at) if isinstance(at, dict) else range(len(at)) if isinstance(at, list) else ()
            else:
                names = [step] if isinstance(at, dict) and step in at else ()
            for place, name in enumerate(names):
                here, label = (*dewey, place if step == "*" else list(at).index(step)), (*path, str(name))
                if "" in below and isinstance(own := decoded(at[name]), dict):
                    yield here, "/".join(label), below[""], None, _json(_pruned(own, below)) if with_fields else None
                stack.append((at[name], below, here, label))


def label_all(document: dict, open_names: frozenset[str] = frozenset()) -> Iterator[tuple]:
    """(dewey, path, schema path, place, own fields) of every object, the document itself included, and of
    every item of a list that holds objects or lists. Names within the objects named open count as ``*``."""
    stack: list[tuple] = [(document, (), (), "", None)]
    while stack:
        node, dewey, path, schema, place = stack.pop()
        if isinstance(node, list):
            items, own = list(enumerate(node)), None
        elif isinstance(node, dict):
            own = {}
            for at, (name, value) in enumerate(node.items()):
                value = decoded(value) if isinstance(value, str) and value.lstrip()[:1] in ("{", "[") else value
                held = list_items(value) if isinstance(value, (dict, list)) else []
                step = "*" if path and path[-1] in open_names else name
                below = f"{schema}/{step}" if schema else step
                listed = isinstance(value, list) or bool(held) and isinstance(value, dict) and all(k.lstrip("-").isdecimal() for k in value)
                if listed and any(isinstance(x, (dict, list)) for _, x in held):
                    stack += [(x, (*dewey, at, i), (*path, name, str(i)), f"{below}[]", i) for i, x in held if x is not None]
                elif isinstance(value, dict) and not listed:
                    stack.append((value, (*dewey, at), (*path, name), below, None))
                else:
                    own[name] = value
            items = []
        else:
            items, own = [], node
        yield dewey, "/".join(path), schema, place, None if own is None else _json(own)
        stack += [(x, (*dewey, i), (*path, str(i)), f"{schema}[]", i) for i, x in items if x is not None]


def _labelled(df: DataFrame, id_col: str, body_col: str, nodes_of) -> DataFrame:
    """One row per node that ``nodes_of(document)`` yields."""
    id_type = df.schema[id_col].dataType.simpleString()
    schema = NODES.format(id=id_col, id_type=id_type)
    ship(df.sparkSession)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_type: pa.Schema | None = None
        ids: list = []
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows)) if rows else [()] * 5
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t.type) for v, t in zip([ids, *columns], out_type)], schema=out_type
            )

        for batch in slices(batches, DOCS_AT_ONCE):
            out_type = pa.schema(
                [
                    (id_col, batch.schema.field(0).type),
                    ("dewey", pa.list_(pa.int32())),
                    ("path", pa.string()),
                    ("schema_path", pa.string()),
                    ("pos", pa.int32()),
                    ("fields", pa.string()),
                ]
            )
            for ident, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                document = parse_document(body.as_py())
                if document is None:
                    continue
                for node in nodes_of(document):
                    ids.append(ident)
                    rows.append(node)
                    if len(rows) >= ROWS_PER_BATCH:
                        yield flush()
                        ids, rows = [], []
        if rows:
            yield flush()

    return df.select(id_col, body_col).mapInArrow(label, schema)


def shred(df: DataFrame, id_col: str, body_col: str, patterns: list[str], with_fields: bool = True) -> DataFrame:
    """Labelled nodes of every document, one row per list item that isn't null and per object under a pattern.

    ``patterns`` name the lists and objects wanted, such as ``trials[]``,
    ``results[]/runs/*`` or ``results[]/runs/*/replicates[]``; nothing else is
    walked, so unwanted parts of a document cost only their parsing. Columns: the
    id, ``dewey``, ``path``, ``schema_path`` (the pattern), ``pos`` (null for objects
    that are no list items) and ``fields`` (JSON of the node without its own tables;
    null unless ``with_fields``).
    """
    return _labelled(df, id_col, body_col, lambda document: label_nodes(document, patterns, with_fields))


def shred_all(df: DataFrame, id_col: str, body_col: str, open_names: tuple[str, ...] = ()) -> DataFrame:
    """The nodes of every document, under the schema paths it turns out to have.

    Columns: the id, ``node_id``, ``parent_id`` (null for the document itself, whose
    id is empty), ``schema_path``, ``parent_path`` (the parent's schema path), ``pos``
    and ``fields``. Every parent has a row. Lists of plain values are values.
    """
    names = frozenset(open_names)
    nodes = _labelled(df, id_col, body_col, lambda document: label_all(document, names))
    schema = F.col("schema_path")
    up = F.when(schema.endswith("[]") & ~schema.endswith("[][]"), 2).otherwise(1)
    above = F.regexp_replace(schema, r"(\[\]|/?[^/\[\]]+(\[\])?)$", "")
    root = F.size("dewey") == 0
    return nodes.select(
        id_col,
        dewey_id(F.col("dewey")).alias("node_id"),
        F.when(~root, dewey_id(F.slice("dewey", 1, F.greatest(F.size("dewey") - up, F.lit(0))))).alias("parent_id"),
        schema.alias("schema_path"),
        F.when(~root, above).alias("parent_path"),
        "pos",
        "fields",
    )


def schema_paths(nodes: DataFrame, id_col: str) -> DataFrame:
    """(schema_path, parent_path, n_nodes, n_docs): the tables that ``shred_all`` found."""
    per_doc = nodes.groupBy("schema_path", "parent_path", id_col).agg(F.count(F.lit(1)).alias("n"))
    return per_doc.groupBy("schema_path", "parent_path").agg(F.sum("n").alias("n_nodes"), F.count(F.lit(1)).alias("n_docs"))


def parent_table(schema_path: str, tables: list[str]) -> tuple[str, int]:
    """The table that holds a table's parents ('' for the document), and how many components their labels lack."""
    steps = lambda p: p.replace("[]", "/[]").split("/") if p else []
    own = steps(schema_path)
    above = max((t for t in ["", *tables] if t != schema_path and own[: len(steps(t))] == steps(t)), key=lambda t: len(steps(t)))
    return above, len(own) - len(steps(above))


def parent_path(path: Column) -> Column:
    """The path of the object that holds an item's list: truncation by two."""
    return F.regexp_replace(path, r"/?[^/]*/[^/]*$", "")


def dewey_id(dewey: Column) -> Column:
    """A label as text that sorts and joins as one key."""
    return F.array_join(F.transform(dewey, lambda x: x.cast("string")), ".")


def linked_table(nodes: DataFrame, id_col: str, schema_path: str, columns: dict[str, str], tables: list[str] | None = None) -> DataFrame:
    """The flat table of one schema path, with ``node_id`` and ``parent_id`` labels.

    ``columns`` maps a field's dotted path to its type; a path the item lacks, or
    whose value doesn't fit the type, comes out null. The path '' stands for the
    item itself, for lists of plain values. An array type reads a list of values;
    an object read as string is its JSON. The parent is the node of the nearest
    schema path above among ``tables``, or the document, whose label is empty;
    without ``tables`` it is the object that holds the node or its list.
    """
    fields = F.col("fields")
    up = parent_table(schema_path, tables)[1] if tables is not None else 2 if schema_path.endswith("[]") else 1
    labels = F.slice("dewey", 1, F.greatest(F.size("dewey") - up, F.lit(0)))
    names = F.slice(F.split("path", "/"), 1, F.greatest(F.size("dewey") - up, F.lit(0)))

    def column(path: str, kind: str) -> Column:
        value = fields if not path else F.get_json_object(fields, "$." + path)
        return F.from_json(value, kind) if kind.startswith("array") else value.try_cast(kind)

    cast = [column(path, kind).alias(path.replace(".", "_") or "value") for path, kind in columns.items()]
    return nodes.filter(F.col("schema_path") == schema_path).select(
        id_col,
        dewey_id(F.col("dewey")).alias("node_id"),
        dewey_id(labels).alias("parent_id"),
        F.array_join(names, "/").alias("parent_path"),
        F.element_at(F.split("path", "/"), -1).alias("name"),
        "pos",
        *cast,
    )


def orphans(child: DataFrame, parent: DataFrame, id_col: str) -> DataFrame:
    """Rows of a linked table whose parent has no row: none, unless the parents were filtered."""
    return child.join(parent.select(id_col, F.col("node_id").alias("parent_id")), [id_col, "parent_id"], "left_anti")
