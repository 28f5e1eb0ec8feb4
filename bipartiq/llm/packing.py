"""Texts into containers of equal capacity, by a grouping genetic algorithm on islands.

A chromosome is a packing, its genes are whole bins. Crossover takes well-filled
bins of one parent into the other, removes the bins that now hold an item twice,
and puts the items this displaces back by best fit, largest first; mutation
dissolves the emptiest bins and some others. Packings compare by their number of
bins, then by the sum of squared fills, so what is left unused gathers in one bin.
Best fit, largest first, is one member of an island's first generation. An island
stops early only at a proven optimum: as few bins as the total size allows, and
all but one of them full to the last token.

Items are spread by hash over cells of about ``CELL_ITEMS`` items, so a task's
work has a bound at any size of the corpus. Every cell evolves on several islands,
each a task of its own; after each epoch an island's best packing migrates to the
next. Of each cell the emptiest bins, those filled below ``FULL`` and at most a
quarter of its bins, are dissolved; their items meet in new, fewer cells in a next
round, until one cell is left, so the cells' leftovers don't add up. A round
leaves at most about a quarter of its volume to the next, whatever the sizes.
Seeds depend on cell, island and epoch alone: a task that runs again on another
executor gives the same packing.

Texts below a 512th of the capacity (of 0 tokens: null, empty) are strung together
to bundles of at least that size first, at most ``BUNDLE_ROWS`` of them, and a
bundle is packed like a text: no cell is ever flooded by them. A text beyond the
capacity fills containers of its own with its first parts, and its rest is packed
like a text. Rows that repeat are packed each.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bipartiq.llm.tokens import TOKENIZERS, VOCABULARY, token_counts
from bipartiq.session import materialize, ship, slices

CAPACITY = 2048
CELL_ITEMS = 512
ISLANDS = 3
EPOCHS = 2
GENERATIONS = 8
POPULATION = 6
#: Share of the capacity from which a bin counts as well filled and stays.
FULL = 0.995
#: Packings that one step of an island's task works on at once.
CELLS_AT_ONCE = 16
#: Rows among which texts of next to no tokens are strung together.
BUNDLE_ROWS = 65_536


class Packing:
    """Bins, as sorted tuples of item numbers that packings share, with their fills."""

    __slots__ = ("bins", "capacity", "fills", "sizes")

    def __init__(self, sizes: list[int], capacity: int, bins: tuple | list = (), fills: tuple | list = ()) -> None:
        self.sizes, self.capacity, self.bins, self.fills = sizes, capacity, list(bins), list(fills)

    def copy(self) -> Packing:
        return Packing(self.sizes, self.capacity, self.bins, self.fills)

    def insert(self, items: list[int]) -> None:
        """Put items into the bins that they fill best, in the order given."""
        fills, old = self.fills, len(self.fills)
        room = sorted((self.capacity - f, i) for i, f in enumerate(fills) if f < self.capacity)
        added: dict[int, list[int]] = {}
        for item in items:
            size = self.sizes[item]
            at = bisect_left(room, (size,))
            if at < len(room):
                left, i = room.pop(at)
                fills[i] += size
            elif not size and fills:  # nothing to store: any bin does, full ones too
                left, i = 0, 0
            else:
                left, i = self.capacity, len(fills)
                fills.append(size)
            added.setdefault(i, []).append(item)
            if left > size:
                insort(room, (left - size, i))
        for i, new in added.items():
            if i < old:
                self.bins[i] = tuple(sorted((*self.bins[i], *new)))
        self.bins += [tuple(sorted(added[i])) for i in range(old, len(fills))]

    def remove_bins(self, doomed: set[int]) -> list[int]:
        """Take bins out; returns their items."""
        freed = [item for i in sorted(doomed) for item in self.bins[i]]
        self.bins = [b for i, b in enumerate(self.bins) if i not in doomed]
        self.fills = [f for i, f in enumerate(self.fills) if i not in doomed]
        return freed

    def rank(self) -> tuple:
        """Smaller is better: fewer bins, then what is unused gathered in few of them."""
        return len(self.bins), -sum(f * f for f in self.fills), self.bins

    def optimal(self) -> bool:
        """Whether no packing can rank before this one, by the total size alone."""
        fewest = max(-(-sum(self.sizes) // self.capacity), 1)
        return len(self.bins) <= fewest and sum(f < self.capacity for f in self.fills) <= 1

    def assignment(self) -> list[int]:
        """The bin of each item; bins are numbered from the fullest."""
        of = [0] * len(self.sizes)
        for n, i in enumerate(sorted(range(len(self.bins)), key=lambda i: (-self.fills[i], self.bins[i]))):
            for item in self.bins[i]:
                of[item] = n
        return of

    @classmethod
    def from_assignment(cls, sizes: list[int], capacity: int, of: list[int]) -> Packing:
        bins: list[list[int]] = [[] for _ in range(max(of, default=-1) + 1)]
        for item, i in enumerate(of):
            bins[i].append(item)
        return cls(sizes, capacity, [tuple(b) for b in bins], [sum(sizes[x] for x in b) for b in bins])


def largest_first(sizes: list[int], items: list[int]) -> list[int]:
    return sorted(items, key=lambda x: (-sizes[x], x))


def best_fit(sizes: list[int], capacity: int) -> Packing:
    """Best fit, largest first."""
    made = Packing(sizes, capacity)
    made.insert(largest_first(sizes, list(range(len(sizes)))))
    return made


def crossover(giver: Packing, taker: Packing, rng: random.Random) -> Packing:
    """The taker with some bins of the giver that it lacks, well-filled ones first."""
    child, own = taker.copy(), set(taker.bins)
    order = sorted((-f * (0.98 + 0.02 * rng.random()), i) for i, f in enumerate(giver.fills) if giver.bins[i] not in own)
    injected = [i for _, i in order[: rng.randint(1, max(1, len(giver.bins) // 16))]]
    taken = {item for i in injected for item in giver.bins[i]}
    doomed = {i for i, b in enumerate(child.bins) if not taken.isdisjoint(b)}
    displaced = [x for x in child.remove_bins(doomed) if x not in taken]
    child.bins += [giver.bins[i] for i in injected]
    child.fills += [giver.fills[i] for i in injected]
    child.insert(largest_first(child.sizes, displaced))
    return child


def mutate(packing: Packing, rng: random.Random) -> None:
    """Dissolve the emptiest bins and two at random."""
    n = len(packing.bins)
    if n < 2:
        return
    order = sorted(range(n), key=lambda i: (packing.fills[i], i))
    freed = packing.remove_bins({*order[: rng.randint(2, 4)], rng.randrange(n), rng.randrange(n)})
    freed.sort(key=lambda x: (-packing.sizes[x] * (0.5 + rng.random()), x))
    packing.insert(freed)


def evolve(
    sizes: list[int],
    capacity: int,
    seed: str,
    start: list[list[int]],
    generations: int = GENERATIONS,
    population: int = POPULATION,
) -> tuple[list[Packing], int]:
    """An island's population after some generations, best first, and how many ran; ``start`` holds assignments."""
    rng = random.Random(seed)
    people = [Packing.from_assignment(sizes, capacity, of) for of in start] or [best_fit(sizes, capacity)]
    items = list(range(len(sizes)))
    while len(people) < population:
        other = Packing(sizes, capacity)
        other.insert(sorted(items, key=lambda x: (-sizes[x] * (0.7 + 0.3 * rng.random()), x)))
        people.append(other)
    people.sort(key=Packing.rank)
    ran = 0
    while ran < generations and not people[0].optimal():
        ran += 1
        children = []
        for _ in range(population // 2):
            giver, taker = rng.sample(people[: max(2, population * 2 // 3)], 2)
            child = crossover(giver, taker, rng)
            mutate(child, rng)
            children.append(child)
        people = sorted([*people, *children], key=Packing.rank)[:population]
    return people, ran


#: An island: its cell's items and sizes, its population as assignments (best first), the best one's
#: fills, and, of the report, the generations run and the bins and full bins of best fit alone.
ISLAND = (
    "cell bigint, island int, items array<bigint>, sizes array<int>, people array<array<int>>, fills array<int>, "
    "generations int, first_bins int, first_full int"
)


def _epoch(islands: DataFrame, capacity: int, epoch: int, salt: str) -> DataFrame:
    """One epoch of every island."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, CELLS_AT_ONCE):
            rows = batch.to_pydict()
            for n, (cell, island, sizes) in enumerate(zip(rows["cell"], rows["island"], rows["sizes"])):
                start = rows["people"][n] or []
                if not epoch:
                    first = best_fit(sizes, capacity)
                    start = [first.assignment()]
                    rows["first_bins"][n], rows["first_full"][n] = len(first.bins), first.fills.count(capacity)
                people, ran = evolve(sizes, capacity, f"{salt}/{cell}/{island}/{epoch}", start)
                rows["people"][n] = [p.assignment() for p in people]
                rows["fills"][n] = sorted(people[0].fills, reverse=True)
                rows["generations"][n] += ran
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in batch.schema], schema=batch.schema)

    return islands.mapInArrow(run, ISLAND)


def pack_cells(items: DataFrame, capacity: int, cells: int, salt: str, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """The best island of every cell: ``items``, ``sizes``, ``of`` (bins, from the fullest), ``fills``, and figures of the report."""
    spark = items.sparkSession
    ship(spark)
    cell = F.pmod(F.xxhash64("item", F.lit(salt)), F.lit(cells)).alias("cell")
    # A cell's items are a set bound by the choice of the number of cells.
    grouped = items.groupBy(cell).agg(F.sort_array(F.collect_list(F.struct("item", F.col("size").cast("int").alias("size")))).alias("i"))
    tasks = max(1, min(cells * islands, max(2 * spark.sparkContext.defaultParallelism, cells * islands // 64)))
    none = F.lit(None)
    world = grouped.select(
        "cell",
        F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island"),
        F.col("i.item").alias("items"),
        F.col("i.size").alias("sizes"),
        none.cast("array<array<int>>").alias("people"),
        none.cast("array<int>").alias("fills"),
        F.lit(0).alias("generations"),
        none.cast("int").alias("first_bins"),
        none.cast("int").alias("first_full"),
    ).repartition(tasks, "cell", "island")
    ring, every = Window.partitionBy("cell").orderBy("island"), Window.partitionBy("cell")
    for epoch in range(epochs):
        world = _epoch(world, capacity, epoch, salt)
        if epoch + 1 < epochs:
            elite = F.element_at("people", 1)
            came = F.coalesce(F.lag(elite).over(ring), F.max_by(elite, "island").over(every))
            world = world.withColumn("people", F.concat(F.array(came), "people")).repartition(tasks, "cell", "island")
    squares = F.aggregate("fills", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)
    best = F.min_by(F.struct("items", "sizes", F.element_at("people", 1).alias("of"), "fills"), F.struct(F.size("fills"), -squares, "island"))
    return world.groupBy("cell").agg(
        best.alias("b"), F.sum("generations").alias("generations"), F.min("first_bins").alias("first_bins"), F.max("first_full").alias("first_full")
    ).select("cell", "b.*", "generations", "first_bins", "first_full")


def bundled(rest: DataFrame, limit: int) -> DataFrame:
    """``item`` and the ``unit`` it is packed in: itself, or for sizes below ``limit`` a bundle of neighbours."""
    tiny = F.col("size") < limit
    chunk = F.floor(F.col("item") / BUNDLE_ROWS)
    before = F.sum("size").over(Window.partitionBy(chunk).orderBy("item")) - F.col("size")
    strung = rest.filter(tiny).select("item", "size", (-1 - chunk * BUNDLE_ROWS - F.floor(before / limit)).cast("long").alias("unit"))
    return rest.filter(~tiny).select("item", "size", F.col("item").alias("unit")).unionByName(strung)


def _rounds(pool: DataFrame, capacity: int, cell_items: int) -> list[DataFrame]:
    """The packed cells of every round, for units (item, size) that all fit a bin."""
    rounds: list[DataFrame] = []
    cells = None
    while True:
        count, total = pool.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
        if not count:
            return rounds
        # Cells of cell_items units, or of fewer but larger cells where these would fill less than 8 bins.
        wanted = max(min(-(-count // cell_items), max(1, total // (8 * capacity))), -(-count // (8 * cell_items)))
        cells = wanted if cells is None else max(1, min(wanted, cells // 2))
        packed = materialize(pack_cells(pool, capacity, cells, str(len(rounds))), "packed")
        rounds.append(packed)
        if cells == 1:
            return rounds
        pool = _placed(packed).filter(_goes_on(capacity)).select("item", "size")


def _placed(packed: DataFrame) -> DataFrame:
    """One row per unit: its ``size``, ``bin``, the bin's ``fill`` and the cell's number of ``bins``."""
    unit = F.explode(F.arrays_zip(F.col("items").alias("item"), F.col("sizes").alias("size"), F.col("of").alias("bin"))).alias("r")
    return packed.select("cell", "fills", unit).select(
        "cell", "r.item", F.col("r.size").cast("long").alias("size"), "r.bin", F.element_at("fills", F.col("r.bin") + 1).alias("fill"), F.size("fills").alias("bins")
    )


def _goes_on(capacity: int):
    """Whether a bin is dissolved for the next round: below FULL, and among its cell's emptiest quarter."""
    return (F.col("fill") < FULL * capacity) & (F.col("bin") >= F.col("bins") - F.greatest(F.lit(1), F.floor(F.col("bins") / 4)))


def _units(sized: DataFrame, ident: str, size: str, capacity: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts' parts that fill containers alone; what is left of each text with its unit; and the units' sizes."""
    numbered = materialize(
        sized.select(ident, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("whole"), F.monotonically_increasing_id().alias("item")),
        "sizes",
    )
    # Parts that fill a container; the rest, or all of a text that fits, is an item. An exact multiple leaves no rest.
    fits = F.col("whole") <= capacity
    full_parts = F.when(fits, 0).otherwise(F.floor(F.col("whole") / capacity)).cast("long")
    full = numbered.filter(~fits).select(ident, "item", F.explode(F.sequence(F.lit(0).cast("long"), full_parts - 1)).alias("part"))
    done = full.select(
        ident, F.col("part").cast("int").alias("part"), F.lit(capacity).cast("long").alias("tokens"), F.concat_ws("-", F.lit("f"), "item", "part").alias("container_id")
    )
    rest = numbered.select(
        ident, "item", full_parts.cast("int").alias("part"), (F.col("whole") - full_parts * capacity).alias("size")
    ).filter((F.col("size") > 0) | (F.col("part") == 0))
    units = bundled(rest.select("item", "size"), max(1, capacity // 512))
    return done, rest.join(units.select("item", "unit"), "item"), units.groupBy(F.col("unit").alias("item")).agg(F.sum("size").alias("size"))


def pack_sizes(sized: DataFrame, ident: str, size: str, capacity: int = CAPACITY, cell_items: int = CELL_ITEMS) -> DataFrame:
    """Assign every row of ``sized`` to containers.

    Columns: ``ident``, ``part`` (from 0; more than one only beyond the capacity),
    ``tokens`` of the part, and ``container_id``.
    """
    done, rest, pool = _units(sized, ident, size, capacity)
    rounds = _rounds(materialize(pool, "units"), capacity, cell_items)
    placed: DataFrame | None = None
    for turn, packed in enumerate(rounds):
        rows = _placed(packed)
        kept = rows if turn + 1 == len(rounds) else rows.filter(~_goes_on(capacity))
        named = kept.select(F.col("item").alias("unit"), F.concat_ws("-", F.lit(str(turn)), "cell", "bin").alias("container_id"))
        placed = named if placed is None else placed.unionByName(named)
    if placed is None:
        return done
    return rest.join(placed, "unit").select(ident, "part", F.col("size").alias("tokens"), "container_id").unionByName(done)


def pack_report(sized: DataFrame, ident: str, size: str, capacity: int = CAPACITY, cell_items: int = CELL_ITEMS) -> DataFrame:
    """What the genetic algorithm did in each round.

    Columns: ``round``, ``cells``, ``cells_evolved`` (in which generations ran),
    ``generations`` (of all islands), ``bins_best_fit`` and ``full_best_fit`` (bins,
    and those full to the last token, by best fit alone), ``bins``, ``full_bins`` and
    ``fill`` (share used of the bins) by the algorithm.
    """
    _, _, pool = _units(sized, ident, size, capacity)
    rounds = _rounds(materialize(pool, "units"), capacity, cell_items)
    full = F.size(F.filter("fills", lambda f: f == capacity))
    used = F.aggregate("fills", F.lit(0).cast("long"), lambda a, x: a + x)
    out: DataFrame | None = None
    for turn, packed in enumerate(rounds):
        row = packed.agg(
            F.count(F.lit(1)).alias("cells"),
            F.count(F.when(F.col("generations") > 0, 1)).alias("cells_evolved"),
            F.sum("generations").alias("generations"),
            F.sum("first_bins").alias("bins_best_fit"),
            F.sum("first_full").alias("full_best_fit"),
            F.sum(F.size("fills")).alias("bins"),
            F.sum(full).alias("full_bins"),
            F.round(F.sum(used) / (F.sum(F.size("fills")) * capacity), 6).alias("fill"),
        ).select(F.lit(turn).alias("round"), "*")
        out = row if out is None else out.unionByName(row)
    if out is None:
        schema = "round int, cells bigint, cells_evolved bigint, generations bigint, bins_best_fit bigint, full_best_fit bigint, bins bigint, full_bins bigint, fill double"
        return sized.sparkSession.createDataFrame([], schema)
    return out


def pack_documents(
    df: DataFrame,
    ident: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    tokenizers: str = TOKENIZERS,
    vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Containers of all texts, with sizes in tokens; see ``pack_sizes`` for the columns."""
    return pack_sizes(token_counts(df, [ident], text, tokenizers, vocabulary), ident, "tokens", capacity)
