"""Layout drift between JSON files: tree edit scripts per file, and one table over all of them.

A file's schema is the tree of its fields: objects are inner nodes, everything else
a leaf with a type. The edit script between the trees of two successive files is
the cheapest mapping of nodes, where

* a path that both files have maps to itself (leaves at the cost of a type change);
* a removed object may map to an added one, with its whole subtree: the constrained
  tree edit distance (Zhang) between the two subtrees, bottom up, with an exact
  assignment of children at every pair of nodes, says what that saves;
* a removed leaf may map to an added one only where the data bear it out: every run
  that both files carry has the same value under either path;
* a mapped node costs its rename, by the share of its name that changes, and its
  move, by the ancestors left and entered after those of its ancestors that are
  mapped themselves; a node that isn't mapped costs 1, deleted or added.

Subtrees that move take their leaves along at no cost; the leaves that are left are
assigned one to one at least total cost, over the whole tree.

The scripts then compile into projections: a field that is renamed keeps the
column it started in, so every record of a stream lands in the same columns,
whatever its file calls them. A file's projection is one small map of old names to
columns, applied to each of its records as it is parsed; no record is taken apart
and put together again. Origins of fields over chains of renames come from pointer
jumping, a number of joins that grows with the logarithm of the longest chain.

Records are parsed once for the schemas, counted by (stream, file, path, type)
within each batch, and once for the evidence, of files with both removed and added
fields alone and of those fields alone. Repeated lines of a run don't matter, and
of different lines of a run the last (largest line number, then record id) gives
its values. Records that aren't JSON objects have no fields and stay in the table,
with all columns null; rows whose stream or file is null form files of their own
only in the table, not in the scripts. A file with fields of several types at once
has the type that most of its records give (ties: the first by name).
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

from bipartiq.operators.nested import parse_document
from bipartiq.session import broadcast_if_small, materialize, ship, slices

RECORDS_AT_ONCE = 4096
#: Files that one window partition orders; the file before a block's first comes from the block before.
FILE_BLOCK = 1024
#: Cost of a leaf's change of type.
RETYPE = 0.5

TYPES = {bool: "boolean", int: "number", float: "number", str: "string", list: "list"}


def leaves(node: object, path: str = "") -> Iterator[tuple[str, object]]:
    """Dotted paths and values of everything in an object that is no object itself."""
    stack = [(path, node)]
    while stack:
        at, value = stack.pop()
        if isinstance(value, dict):
            stack.extend((f"{at}.{k}" if at else k, x) for k, x in value.items())
        else:
            yield at, value


def _plain(value: object) -> object:
    """Numbers in one form: a float without a fraction as an integer."""
    if isinstance(value, float):
        return int(value) if value.is_integer() else value
    if isinstance(value, list):
        return [_plain(x) for x in value]
    return {k: _plain(x) for k, x in value.items()} if isinstance(value, dict) else value


def canonical(value: object) -> str:
    """One text per JSON value: 2 and 2.0 are equal, 2 and "2" are not."""
    return json.dumps(_plain(value), sort_keys=True, ensure_ascii=False)


def successive(files: DataFrame, stream: str, seq: str) -> DataFrame:
    """Each file of a stream with the one before it, in ``before__``.

    Two levels keep even a stream with most of all files out of a single task:
    inside blocks of file numbers by a window, across them by the blocks' ends.
    """
    block = F.floor(F.col(seq) / FILE_BLOCK)
    within = Window.partitionBy(stream, "block__").orderBy(seq)
    across = Window.partitionBy(stream).orderBy("block__")
    blocked = files.select(stream, seq, block.alias("block__"))
    ends = (
        blocked.groupBy(stream, "block__").agg(F.max(seq).alias("end__")).withColumn("end__", F.lag("end__").over(across))
    )
    return (
        blocked.withColumn("lag__", F.lag(seq).over(within))
        .join(ends, [stream, "block__"])
        .select(stream, seq, F.coalesce("lag__", "end__").alias("before__"))
        .filter(F.col("before__").isNotNull())
    )


# ---- tree edit distance ------------------------------------------------------


@lru_cache(maxsize=65536)
def name_distance(a: str, b: str) -> int:
    """Levenshtein distance of two names."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def _parts(path: str) -> tuple[str, ...]:
    return tuple(path.split("."))


def edit_cost(old: tuple[str, ...], new: tuple[str, ...]) -> float:
    """Cost of one rename or move: below 2, that of a deletion and an addition.

    Each ancestor left or entered counts, and so does the share of the node's name
    that changes.
    """
    shared = 0
    while shared < min(len(old), len(new)) - 1 and old[shared] == new[shared]:
        shared += 1
    moved = len(old) + len(new) - 2 * shared - 2
    depth = max(len(old) + len(new) - 2, 1)
    return moved / depth + 0.9 * name_distance(old[-1], new[-1]) / max(len(old[-1]), len(new[-1]), 1)


def assignment(cost: dict[tuple, float]) -> list[tuple]:
    """The one-to-one choice of pairs of least total cost; pairs of a cost of 0 or more stay out.

    Successive shortest paths over the pairs alone, so the work depends on how
    many pairs there are, which is few. Ties fall by name.
    """
    pairs = sorted(p for p, c in cost.items() if c < 0)
    news: dict = {}
    olds: dict = {}
    while True:
        best: dict = {o: (0.0, ()) for o in sorted({p[0] for p in pairs} - set(olds))}
        target: tuple[float, tuple] | None = None
        for _ in range(len(pairs) + 1):  # Bellman-Ford: an alternating path visits each old name once at most
            changed = False
            for old, new in pairs:
                if old not in best or olds.get(old) == new:
                    continue
                reached = best[old][0] + cost[old, new]
                steps = (*best[old][1], (old, new))
                holder = news.get(new)
                if holder is None:
                    if reached < -1e-12 and (target is None or reached < target[0] - 1e-12):
                        target, changed = (reached, steps), True
                else:
                    back = reached - cost[holder, new]
                    if holder not in best or back < best[holder][0] - 1e-12:
                        best[holder], changed = (back, steps), True
            if not changed:
                break
        if target is None:
            return sorted(olds.items())
        for old, new in target[1]:
            olds[old] = new
            news[new] = old


class SchemaTree:
    """A schema by its leaves; inner nodes are the proper prefixes of their paths."""

    def __init__(self, fields: Iterable[str]) -> None:
        self.leaves = {_parts(f) for f in fields}
        self.inner = {leaf[:n] for leaf in self.leaves for n in range(1, len(leaf))}

    def without(self, other: SchemaTree) -> tuple[set, set]:
        """The leaves and inner nodes that the other tree lacks; below such an inner node it lacks all."""
        return self.leaves - other.leaves, self.inner - other.inner


def _children(leaves_: set, inner: set) -> dict:
    """The leaf and inner children of each of the inner nodes."""
    below: dict = {x: ([], []) for x in inner}
    for kind, nodes in enumerate((leaves_, inner)):
        for node in sorted(nodes):
            if node[:-1] in below:
                below[node[:-1]][kind].append(node)
    return below


def _weight(node: tuple, below: dict) -> int:
    leaf_kids, inner_kids = below[node]
    return 1 + len(leaf_kids) + sum(_weight(x, below) for x in inner_kids)


def subtree_savings(gone: tuple[set, set], come: tuple[set, set], borne: set[tuple]) -> dict[tuple, tuple[float, list]]:
    """For each pair of a removed and an added inner node what mapping one to the other saves below them,
    against deleting and adding both subtrees, with the inner pairs mapped on the way.

    Bottom up: children that are inner nodes save what their own pairs do, leaves
    that the data bear out 2 less their rename; an exact assignment of children
    takes the best of both. Only pairs with a leaf borne out somewhere below count.
    """
    old, new = _children(*gone), _children(*come)
    reach = {(o[:i], n[:j]) for o, n in borne for i in range(1, len(o)) for j in range(1, len(n)) if o[:i] in old and n[:j] in new}
    saved: dict[tuple, tuple[float, list]] = {}
    for x, y in sorted(reach, key=lambda p: (-len(p[0]), -len(p[1]), p)):
        cost = {(a, b): edit_cost(a[-1:], b[-1:]) - 2 for a in old[x][0] for b in new[y][0] if (a, b) in borne}
        cost |= {(a, b): edit_cost(a[-1:], b[-1:]) - saved[a, b][0] for a in old[x][1] for b in new[y][1] if (a, b) in saved}
        chosen = assignment(cost)
        if chosen:
            below = [p for a, b in chosen if (a, b) in saved for p in [(a, b), *saved[a, b][1]]]
            saved[x, y] = (2 - sum(cost[p] for p in chosen), below)
    return saved


def inner_mapping(gone: tuple[set, set], come: tuple[set, set], borne: set[tuple]) -> list[tuple]:
    """The removed inner nodes that map to added ones: subtrees that save most, none within another's."""
    saved = subtree_savings(gone, come, borne)
    chosen: list[tuple] = []
    open_ = {p: edit_cost(*p) - s for p, (s, _) in saved.items()}
    within = lambda a, b: a[: len(b)] == b or b[: len(a)] == a
    while open_:
        picked = assignment(open_)
        # Of pairs whose subtrees overlap the one that saves most stays; the others are assigned anew.
        settled: list[tuple] = []
        for x, y in sorted(picked, key=lambda p: (open_[p], p)):
            if not any(within(x, a) or within(y, b) for a, b in settled):
                settled.append((x, y))
        if not settled:
            break
        chosen += settled
        if len(settled) == len(picked):
            break
        open_ = {(x, y): c for (x, y), c in open_.items() if not any(within(x, a) or within(y, b) for a, b in chosen)}
    return [q for p in chosen for q in (p, *saved[p][1])]


def _image(path: tuple, mapped: dict) -> tuple:
    """A path after the mappings of its ancestors."""
    for n in range(len(path) - 1, 0, -1):
        if path[:n] in mapped:
            return (*mapped[path[:n]], *path[n:])
    return path


def edit_script(old: dict[str, str], new: dict[str, str], borne: Iterable[tuple[str, str]]) -> list[tuple]:
    """The cheapest script from one schema (field to type) to another.

    ``borne`` holds the pairs of removed and added fields that the data bear out.
    Rows (op, kind, field, new_field, cost): op is delete, add, rename, move,
    carry (a node that moves along with an ancestor), or retype; kind is leaf or object.
    """
    a, b = SchemaTree(old), SchemaTree(new)
    gone, come = a.without(b), b.without(a)
    pairs = {(_parts(o), _parts(n)) for o, n in borne if _parts(o) in gone[0] and _parts(n) in come[0]}

    def finish(inner: list[tuple]) -> tuple[float, list[tuple], list[tuple]]:
        mapped = dict(inner)
        costs = {(x, y): edit_cost(_image(x, mapped), y) for x, y in inner}
        leaf = {(o, n): edit_cost(_image(o, mapped), n) for o, n in pairs}
        chosen = assignment({p: c - 2 for p, c in leaf.items()})
        total = sum(costs.values()) - 2 * len(inner) + sum(leaf[p] - 2 for p in chosen)
        return total, [(*p, costs[p]) for p in sorted(inner)], [(*p, leaf[p]) for p in chosen]

    plans = [finish([])]
    if gone[1] and come[1] and pairs:
        plans.append(finish(inner_mapping(gone, come, pairs)))
    _, inner, leaf = min(plans, key=lambda p: p[0])

    mapped = {x: y for x, y, _ in inner}
    rows = []
    for kind, found, which in (("object", inner, 1), ("leaf", leaf, 0)):
        for x, y, cost in found:
            image = _image(x, mapped)
            op = "carry" if image == y else "rename" if image[:-1] == y[:-1] else "move"
            rows.append((op, kind, ".".join(x), ".".join(y), cost))
        left, taken = {x for x, _, _ in found}, {y for _, y, _ in found}
        rows += [("delete", kind, ".".join(x), "", 1.0) for x in sorted(gone[which] - left)]
        rows += [("add", kind, ".".join(y), "", 1.0) for y in sorted(come[which] - taken)]
    rows += [("retype", "leaf", f, "", RETYPE) for f in sorted(set(old) & set(new)) if old[f] != new[f]]
    return rows


# ---- the operator --------------------------------------------------------------


class Drift:
    """The layout changes of all streams of JSON records, and the table they compile into.

    ``stream`` and ``seq`` name the columns that order files, ``run`` the one whose
    values repeat between a file and the next, ``line`` and ``ident`` those that
    order and identify records.
    """

    def __init__(
        self,
        records: DataFrame,
        stream: str = "stream_id",
        seq: str = "file_seq",
        run: str = "run_key",
        line: str = "line_no",
        ident: str = "rec_id",
        body: str = "body",
    ) -> None:
        self.records, self.body = records, body
        self.stream, self.seq, self.run, self.line, self.ident = stream, seq, run, line, ident
        self._counted: DataFrame | None = None
        self._found: DataFrame | None = None
        ship(records.sparkSession)

    def _ddl(self, *columns: str) -> str:
        return ", ".join(f"`{c}` {self.records.schema[c].dataType.simpleString()}" for c in columns)

    def counted(self) -> DataFrame:
        """(stream, file, field, type, n): records of each field and type; one row with a null field per file."""
        if self._counted is not None:
            return self._counted
        file = [self.stream, self.seq]

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, RECORDS_AT_ONCE):
                found: Counter = Counter()
                for a, b, text in zip(*(c.to_pylist() for c in batch.columns)):
                    found[a, b, None, None] += 1
                    document = parse_document(text)
                    for path, value in leaves(document) if document else ():
                        if value is not None:
                            found[a, b, path, TYPES[type(value)]] += 1
                columns = list(zip(*found)) or [()] * 4
                kinds = [batch.schema.field(0).type, batch.schema.field(1).type, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, k) for c, k in zip(columns, kinds)), pa.array(found.values(), pa.int64())], names=[*file, "field", "type", "n"]
                )

        known = self.records.filter(F.col(self.stream).isNotNull() & F.col(self.seq).isNotNull()).select(*file, self.body)
        counts = known.mapInArrow(count, f"{self._ddl(*file)}, field string, type string, n bigint")
        self._counted = materialize(counts.groupBy(*file, "field", "type").agg(F.sum("n").alias("n")), "schemas")
        return self._counted

    def schemas(self) -> DataFrame:
        """Type and number of records of every field of every file."""
        return self.counted().filter(F.col("field").isNotNull()).groupBy(self.stream, self.seq, "field").agg(
            F.min_by("type", F.struct(-F.col("n"), F.col("type"))).alias("type"), F.sum("n").alias("n_records")
        )

    def _steps(self) -> DataFrame:
        """Each file with the one before it: both schemas, and the fields that one of them lacks."""
        stream, seq = self.stream, self.seq
        files = self.counted().select(stream, seq).distinct()
        # A file's schema is one row: as many entries as it has fields.
        trees = self.schemas().groupBy(stream, seq).agg(F.sort_array(F.collect_list(F.struct("field", "type"))).alias("fields"))
        none = F.array().cast("array<struct<field:string,type:string>>")
        paired = (
            successive(files, stream, seq)
            .join(trees.withColumnRenamed("fields", "new"), [stream, seq], "left")
            .join(trees.select(stream, F.col(seq).alias("before__"), F.col("fields").alias("old")), [stream, "before__"], "left")
            .select(stream, seq, "before__", F.coalesce("old", none).alias("old"), F.coalesce("new", none).alias("new"))
        )
        gone, come = F.array_except("old.field", "new.field"), F.array_except("new.field", "old.field")
        return paired.withColumn("gone", gone).withColumn("come", come)

    def _evidence(self, steps: DataFrame) -> DataFrame:
        """(stream, file, evidence): in how many common runs each removed and added field, and each pair of them with equal values, occurs."""
        stream, seq, run, line, ident = self.stream, self.seq, self.run, self.line, self.ident
        open_ = steps.filter((F.size("gone") > 0) & (F.size("come") > 0))
        roles = open_.select(stream, F.col("before__").alias("at"), F.col(seq).alias("step"), F.lit(0).alias("role"), F.col("gone").alias("names")).unionByName(
            open_.select(stream, F.col(seq).alias("at"), F.col(seq).alias("step"), F.lit(1).alias("role"), F.col("come").alias("names"))
        )
        # A file has two entries at most: as the earlier one of a step, and as the later one.
        wanted = materialize(roles.groupBy(stream, F.col("at").alias(seq)).agg(F.collect_list(F.struct("step", "role", "names")).alias("wanted")), "wanted")
        width = wanted.agg(F.coalesce(F.max(F.length(F.to_json("wanted"))), F.lit(1))).first()[0]
        kept = [stream, run, line, ident]
        taken = (
            self.records.filter(F.col(run).isNotNull())
            .select(stream, seq, run, line, ident, self.body)
            .join(broadcast_if_small(wanted, wanted.count(), 2 * width), [stream, seq])
            .select(*kept, self.body, "wanted")
        )

        def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, RECORDS_AT_ONCE):
                source: list[int] = []
                rows: list[tuple] = []
                for n, (text, entries) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                    document = parse_document(text)
                    found = dict(leaves(document)) if document else {}
                    for entry in entries:
                        own = [(x, canonical(found[x])) for x in entry["names"] if found.get(x) is not None]
                        for name, value in [(None, None), *own]:  # the first says that the file carries the run
                            source.append(n)
                            rows.append((entry["step"], entry["role"], name, value))
                part = batch.take(pa.array(source, pa.int32()))
                columns = list(zip(*rows)) or [()] * 4
                kinds = [batch.schema.field(5).type.value_type.field("step").type, pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[*kept, "step", "role", "field", "value"]
                )

        step_kind = self.records.schema[seq].dataType.simpleString()
        last = F.max(F.struct(line, ident, "value")).alias("last")
        per_run = (
            taken.mapInArrow(values, f"{self._ddl(*kept)}, step {step_kind}, role int, field string, value string")
            .groupBy(stream, "step", run, "role", "field")
            .agg(last)
            .groupBy(stream, "step", run)  # as many entries as the two files have fields of their own, and two
            .agg(F.collect_list(F.struct("role", "field", F.col("last.value").alias("value"))).alias("e"))
        )
        side = lambda role: F.filter("e", lambda x: (x["role"] == role) & x["field"].isNotNull())
        both = F.size(F.array_distinct(F.transform(F.filter("e", lambda x: x["field"].isNull()), lambda x: x["role"]))) == 2
        entry = lambda o, n: F.struct(o.alias("o"), n.alias("n"))
        none = F.lit(None).cast("string")
        met = F.flatten(
            F.transform("a", lambda o: F.transform(F.filter("b", lambda n: n["value"] == o["value"]), lambda n: entry(o["field"], n["field"])))
        )
        seen = F.concat(F.transform("a", lambda o: entry(o["field"], none)), F.transform("b", lambda n: entry(none, n["field"])), met)
        counts = (
            per_run.filter(both)
            .select(stream, "step", side(0).alias("a"), side(1).alias("b"))
            .select(stream, "step", F.explode(seen).alias("x"))
            .groupBy(stream, "step", "x.o", "x.n")
            .agg(F.count(F.lit(1)).alias("c"))
        )
        return counts.groupBy(stream, F.col("step").alias(seq)).agg(F.collect_list(F.struct("o", "n", "c")).alias("evidence"))

    def scripts(self) -> DataFrame:
        """The edit script of every file after the first of its stream.

        Columns: the stream, the later file, ``op``, ``kind``, ``field``, ``new_field``
        (empty where the op has one path) and ``cost``; see ``edit_script``.
        """
        if self._found is not None:
            return self._found
        steps = materialize(self._steps(), "steps")
        stream, seq = self.stream, self.seq
        full = steps.select(stream, seq, "old", "new").join(self._evidence(steps), [stream, seq], "left")

        def script(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, 64):
                source: list[int] = []
                rows: list[tuple] = []
                for n, (old, new, evidence) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:5]))):
                    count = {(e["o"], e["n"]): e["c"] for e in evidence or ()}
                    borne = [p for p, c in count.items() if None not in p and c == count[p[0], None] == count[None, p[1]]]
                    found = edit_script({x["field"]: x["type"] for x in old}, {x["field"]: x["type"] for x in new}, borne)
                    source += [n] * len(found)
                    rows += found
                part = batch.take(pa.array(source, pa.int32()))
                columns = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:2], *(pa.array(c, pa.string()) for c in columns[:4]), pa.array(columns[4], pa.float64())],
                    names=[stream, seq, "op", "kind", "field", "new_field", "cost"],
                )

        schema = f"{self._ddl(stream, seq)}, op string, kind string, field string, new_field string, cost double"
        self._found = materialize(full.mapInArrow(script, schema), "scripts")
        return self._found

    def changes(self) -> DataFrame:
        """Every change of a field between a file and the one before it.

        Columns: the stream, the later file, ``change`` (added, removed, renamed,
        type), ``field`` and ``new_field`` (empty except for renamed).
        """
        op = F.col("op")
        change = F.when(op == "delete", "removed").when(op == "add", "added").when(op == "retype", "type").otherwise("renamed")
        return self.scripts().filter("kind = 'leaf'").select(self.stream, self.seq, change.alias("change"), "field", "new_field")

    def origins(self) -> DataFrame:
        """For each span of files in which a field bears a name, the name it started with.

        Columns: the stream, ``field``, ``since`` (first file under this name, null
        for the stream's first layout) and ``origin``.
        """
        stream, seq = self.stream, self.seq
        changes = self.changes()
        starts = changes.filter("change in ('added', 'renamed')").select(
            stream,
            F.when(F.col("change") == "renamed", F.col("new_field")).otherwise(F.col("field")).alias("field"),
            F.col(seq).alias("since"),
            F.when(F.col("change") == "renamed", F.col("field")).alias("was"),
        )
        # The name a rename ends was begun by the last start of that name before it, or by the first layout.
        ends = starts.filter(F.col("was").isNotNull()).select(
            stream, F.col("was").alias("field"), F.col("since").alias("until"), F.col("field").alias("now")
        )
        events = starts.select(stream, "field", F.col("since").alias("at"), F.lit(1).alias("begins"), F.lit(None).cast("string").alias("now")).unionByName(
            ends.select(stream, "field", F.col("until").alias("at"), F.lit(0).alias("begins"), "now")
        )
        before = Window.partitionBy(stream, "field").orderBy("at", "begins").rowsBetween(Window.unboundedPreceding, -1)
        begun = F.last(F.when(F.col("begins") == 1, F.col("at")), True).over(before)
        links = (
            events.withColumn("from_since", begun)
            .filter("begins = 0")
            .select(stream, F.col("now").alias("field"), F.col("at").alias("since"), F.col("field").alias("was"), F.col("from_since").alias("was_since"))
        )
        state = materialize(
            starts.select(stream, "field", "since").join(links, [stream, "field", "since"], "left").select(
                stream, "field", "since", F.coalesce("was", "field").alias("origin"), F.when(F.col("was").isNull(), F.col("since")).otherwise(F.col("was_since")).alias("origin_since"),
                F.col("was").isNotNull().alias("open"),
            ),
            "origins",
        )
        while state.filter("open").limit(1).count():
            hop = state.select(
                stream, F.col("field").alias("origin"), F.col("since").alias("origin_since"),
                F.col("origin").alias("next"), F.col("origin_since").alias("next_since"), F.col("open").alias("next_open"),
            )
            state = materialize(
                state.alias("s").join(hop.alias("h"), [stream, "origin", "origin_since"], "left").select(
                    stream, "field", "since",
                    F.when(F.col("open"), F.coalesce("next", "origin")).otherwise(F.col("origin")).alias("origin"),
                    F.when(F.col("open") & F.col("next").isNotNull(), F.col("next_since")).otherwise(F.col("origin_since")).alias("origin_since"),
                    (F.col("open") & F.coalesce("next_open", F.lit(False))).alias("open"),
                ),
                "origins",
            )
        return state.select(stream, "field", "since", "origin")

    def projections(self) -> DataFrame:
        """(stream, file, columns): each file's map of fields to the columns they go into, of fields whose column has another name."""
        stream, seq = self.stream, self.seq
        origins = self.origins().withColumn("kind", F.lit(0))
        uses = self.schemas().select(stream, "field", F.col(seq).alias("since"), F.lit(None).cast("string").alias("origin"), F.lit(1).alias("kind"))
        upto = Window.partitionBy(stream, "field").orderBy("since", "kind").rowsBetween(Window.unboundedPreceding, 0)
        named = (
            origins.unionByName(uses)
            .withColumn("origin", F.last("origin", True).over(upto))
            .filter("kind = 1")
            .select(stream, F.col("since").alias(seq), "field", F.coalesce("origin", "field").alias("column"))
        )
        first = Window.partitionBy(stream, seq, "column").orderBy((F.col("field") != F.col("column")).cast("int"), "field")
        return (
            named.withColumn("place", F.row_number().over(first))
            .filter("field != column AND place = 1")
            .groupBy(stream, seq)
            .agg(F.map_from_entries(F.collect_list(F.struct("field", "column"))).alias("columns"))
        )

    def unified(self) -> DataFrame:
        """One row per record: its own columns without the body, and ``fields``.

        ``fields`` maps each field's first name to its value as JSON, whatever the
        record's file calls it. Two fields of a record that go back to one name are
        both kept: the later one under its present name. Where the records have a
        column ``fields`` of their own, the map is named ``fields_``. The body is
        parsed and projected record by record; only the files' projections are joined.
        """
        maps = materialize(self.projections(), "projections")
        width = maps.agg(F.coalesce(F.max(F.length(F.to_json("columns"))), F.lit(1))).first()[0]
        small = broadcast_if_small(maps.withColumnRenamed("columns", "columns__"), maps.count(), 2 * width)
        own = [c for c in self.records.columns if c != self.body]
        name = "fields"
        while name in own:
            name += "_"
        joined = self.records.join(small, [self.stream, self.seq], "left").select(*own, F.col(self.body).alias("body__"), "columns__")
        schema = StructType([self.records.schema[c] for c in own] + [StructField(name, MapType(StringType(), StringType()))])

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, RECORDS_AT_ONCE):
                out = []
                for text, columns in zip(batch.column(len(own)).to_pylist(), batch.column(len(own) + 1).to_pylist()):
                    document, to = parse_document(text), dict(columns or ())
                    values = {} if document is None else {to.get(f, f): canonical(v) for f, v in leaves(document) if v is not None}
                    out.append(sorted(values.items()) or None)
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(out, pa.map_(pa.string(), pa.string()))], names=[*own, name])

        return joined.mapInArrow(project, schema)


def typed(fields: str, column: str, kind: str):
    """One column of the unified table: its value cast to ``kind``, null where it doesn't fit."""
    return F.get_json_object(F.concat(F.lit('{"x":'), F.element_at(F.col(fields), column), F.lit("}")), "$.x").try_cast(kind)
