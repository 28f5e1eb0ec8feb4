"""Solvers by name, and their runs over grids of graphs, settings and seeds."""

from __future__ import annotations

import inspect
import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from bipartiq.kernels import deterministic as det
from bipartiq.kernels import stochastic as sto
from bipartiq.kernels.dense import MAX_CELLS, DenseGraph, Solution, better, repaired
from bipartiq.operators.reduction import reduce_graph
from bipartiq.session import materialize, ship

Solver = Callable[..., Solution]


@dataclass
class MethodResult:
    """What a solver found, in original ids, with its measures."""

    method: str
    us: list[int]
    vs: list[int]
    edges: int
    missing: int
    theta_feasible: bool
    k_valid: bool
    wall_time_s: float
    time_to_best_s: float | None = None
    meta: dict = field(default_factory=dict)

    @property
    def valid(self) -> bool:
        return self.theta_feasible and self.k_valid


@dataclass
class Method:
    """A named solver with its parameters."""

    name: str
    solver: Solver
    params: dict
    label: str = ""

    def solve(self, g: DenseGraph, k: int, theta: int, seed: int = 0) -> MethodResult:
        began = time.monotonic()
        trace = sto.Trace()
        takes = inspect.signature(self.solver).parameters
        extra = {"seed": seed} if "seed" in takes else {}
        if "trace" in takes:
            extra["trace"] = trace
        s = self.solver(g, k, theta, **{**extra, **self.params})
        took = time.monotonic() - began
        edges = s.edges(g)
        first = next((e["elapsed_s"] for e in trace.epochs if e["edges"] == edges), took)
        missing = len(s.us) * len(s.vs) - edges
        pool = [(g.u_ids[x.us].tolist(), g.v_ids[x.vs].tolist(), x.edges(g)) for x in getattr(s, "pool", [])]
        return MethodResult(
            self.label or self.name, g.u_ids[s.us].tolist(), g.v_ids[s.vs].tolist(), edges, missing,
            s.feasible(theta), missing <= k, took, first, {"params": self.params, "epoch_trace": trace.epochs, "solutions": pool},
        )


_REGISTRY: dict[str, tuple[str, Solver, dict]] = {}


def _plain(name: str) -> str:
    return name.lower().replace("_", "-")


def register_method(name: str, solver: Solver, aliases: tuple[str, ...] = (), **defaults) -> None:
    """Make ``solver(graph, k, theta, **params)`` available by name; a known name is replaced."""
    for n in (name, *aliases):
        _REGISTRY[_plain(n)] = (name, solver, defaults)


def list_methods() -> list[str]:
    return sorted({name for name, _, _ in _REGISTRY.values()})


def make_method(name: str, label: str = "", **params) -> Method:
    """A method by name, whatever its case and its dashes."""
    if _plain(name) not in _REGISTRY:
        raise ValueError(f"unknown method {name!r}; known: {', '.join(list_methods())}")
    full, solver, defaults = _REGISTRY[_plain(name)]
    given = {_ALIASES.get(k, k): v for k, v in params.items() if k not in _NO_EFFECT}
    return Method(full, solver, {**defaults, **given}, label)


#: Spellings of parameters that older settings files use.
_ALIASES = {"pheremone": "pheromone", "β": "beta", "iters": "iterations"}


def method_from_dict(spec: dict) -> Method:
    """From {"method", "params", "label"}, or with the parameters beside the name."""
    spec = dict(spec)
    name, label = spec.pop("method"), spec.pop("label", "")
    spec.pop("id", None)
    return make_method(name, label, **spec.pop("params", {}), **spec)


#: Parameters that steer threads and printing elsewhere: runs are tasks here, so they are taken and have no effect.
_NO_EFFECT = ("parallelize", "force_gc", "verbose")


def _colony(solver: Solver) -> Solver:
    """An ant colony under the parameter names of settings files."""

    def run(
        g: DenseGraph, k: int, theta: int, seed: int = 0, trace=None, pheromone: int = 1, elite_seed=True, elite_seed_ants: int = 3, elite_seed_remove: int = 2,
        best_only_pheromone: bool = False, greedy_fill="off", **options,
    ) -> Solution:
        if best_only_pheromone and options.get("elite_pheromone"):
            raise ValueError("best_only_pheromone and elite_pheromone exclude each other")
        fills = {False: "off", None: "off", True: "end"}
        elites = elite_seed if isinstance(elite_seed, tuple) else (elite_seed_ants, elite_seed_remove) if elite_seed else None
        return solver(
            g, k, theta, seed, trace=trace, pheromone=pheromone > 0, deposit=float(pheromone) or 1.0, elite_seed=elites,
            best_only=options.pop("best_only", best_only_pheromone), greedy_fill=fills.get(greedy_fill, greedy_fill) if not isinstance(greedy_fill, str) else greedy_fill.lower(),
            **options,
        )

    return run


def _exact(
    g: DenseGraph, k: int, theta: int, mode: str = "pivot", use_heuristic: bool = True, num_solutions: int = 1, initial_seed=None, deadline_s: float | None = None
) -> Solution:
    """The exact search; ``initial_seed`` (left ids, right ids) is its first bound besides the heuristic's solution."""
    seed = Solution.empty()
    if use_heuristic and g.n_u and g.n_v:
        seed = repaired(g, det.theta_heuristic(g, k, theta), k, theta)
    if initial_seed:
        us, vs = initial_seed
        own = Solution.of(np.flatnonzero(np.isin(g.u_ids, us)), np.flatnonzero(np.isin(g.v_ids, vs)))
        seed = better(g, seed, repaired(g, own, k, theta), theta)
    limit = None if deadline_s is None else time.monotonic() + deadline_s
    found, _ = det.exact(g, k, theta, seed, deadline=limit, num_solutions=num_solutions, mode=mode)
    best = found[0] if found else Solution.empty()
    best.pool = found
    return best


def _best_side(solver: Solver) -> Solver:
    """Run on the smaller side, on a chosen one, or on both."""

    def run(g: DenseGraph, k: int, theta: int, side: str = "smaller", **params) -> Solution:
        sides = {"U": [True], "V": [False], "both": [True, False], "smaller": [g.n_u <= g.n_v], "larger": [g.n_u > g.n_v]}[side]
        best = Solution.empty()
        for left in sides:
            s = solver(g if left else g.transposed(), k, theta, **params)
            best = better(g, best, s if left else s.swapped(), theta)
        return best

    return run


def _super(g: DenseGraph, k: int, theta: int, seed: int = 0, patience: int = 2, max_cycles: int = 8, ants: int = 100, iterations: int = 5, eta_exp: float = 2.0) -> Solution:
    finish = lambda part, cycle: sto.ant_colony(part, k, theta, seed + cycle, ants, iterations, eta_exp=eta_exp)
    return det.super_heuristic(g, k, theta, finish, patience, max_cycles)


def _edges(g: DenseGraph, k: int, theta: int, seed: int = 0, trace=None, **options) -> Solution:
    """Trails on edges; the other side is packed at the end of each walk, and the epoch's best lay trails."""
    options = {"greedy_fill": "end", "elite_pheromone": True} | {k: v for k, v in options.items() if (k, v) != ("greedy_fill", "off")}
    return sto.ant_colony(g, k, theta, seed, trace=trace, edge_trails=True, **options)


register_method("heuristic", det.theta_heuristic, return_invalid=True, incremental=False)
register_method("pivot", _exact, ("opponent", "branch"))
register_method("double-greedy", det.double_greedy)
register_method("tug", det.tug, ("tow", "alternation"), seed_source="sc", num_seeds=10, max_shakes=3, peel=True)
register_method("clique-order", _best_side(det.clique_order), side="both")
register_method("clique-order-edge", _best_side(det.clique_order_edge), side="smaller")
register_method("super-heuristic", _super)
register_method("aco", _colony(sto.ant_colony), ants=100, iterations=5)
register_method("edges", _colony(_edges), ants=100, iterations=5)
register_method("split_aco", sto.split_colony, ants=10, iterations=5, n_seeds=50)
register_method("one_side_aco", sto.one_side_colony, ants=100, iterations=5)
register_method("oracle_aco", sto.oracle_colony, ants=20, iterations=5)
register_method("clique_aco", sto.clique_colony, ants=100, iterations=5)
register_method("diffusion", sto.diffusion_colony, diffusion_iters=20)
register_method("vns", sto.variable_neighbourhood, kmax=10)
register_method("retry", sto.retry, beta=0.04, p=1.0, max_steps=10_000)
register_method("tabu", sto.tabu, N=10, tt=3, tabu_patience=10)
register_method("ga", sto.genetic, N=10, O=2, k_mutate=0.02, generations=500, repair="mixed", H=2, use_heuristic=True)


RESULT = (
    "dataset string, method string, params string, seed bigint, replicate int, edges bigint, missing bigint, n_u int, n_v int, "
    "theta_feasible boolean, k_valid boolean, wall_time_s double, time_to_best_s double, us array<bigint>, vs array<bigint>, "
    "epoch_trace string, status string"
)


def run_grid(
    graphs: dict[str, DataFrame], specs: list[dict], k: int, theta: int, seeds: list[int], reduction: str = "simple", done: DataFrame | None = None,
    max_cells: int = MAX_CELLS,
) -> DataFrame:
    """One row per graph, method and seed: every run is a task of its own.

    Each graph is reduced once, relationally, and collected below a checked size.
    Graphs are broadcast together while their matrices sum up to no more than one
    graph may have; beyond that they run in several waves, each with a broadcast of
    its own that goes with it. A run that raises gives a row with its error as
    status and nulls as its measures. Rows of ``done`` (dataset, method, seed)
    aren't run again.
    """
    if not graphs:
        raise ValueError("no graphs")
    ship(next(iter(graphs.values())).sparkSession)
    wave: dict[str, DenseGraph] = {}
    waves: list[DataFrame] = []
    for name, edges in graphs.items():
        g = DenseGraph.collect(reduce_graph(edges, k, theta, reduction), max_cells)
        if wave and sum(x.matrix.size for x in wave.values()) + g.matrix.size > max_cells:
            waves.append(_run_wave(edges.sparkSession, wave, specs, k, theta, seeds, done, True))
            wave = {}
        wave[name] = g
    waves.append(_run_wave(edges.sparkSession, wave, specs, k, theta, seeds, done, bool(waves)))
    return reduce(DataFrame.unionByName, waves)


def _run_wave(spark, small: dict[str, DenseGraph], specs: list[dict], k: int, theta: int, seeds: list[int], done: DataFrame | None, now: bool) -> DataFrame:
    """The runs over graphs that fit one broadcast; with ``now`` they run at once and the broadcast goes."""
    shared = spark.sparkContext.broadcast({name: g.packed() for name, g in small.items()})
    graphs = list(small)
    labels = [s.get("label") or s.get("id") or s["method"] for s in specs]
    rows = [
        (d, label, json.dumps(spec), int(seed), i)
        for d in graphs for spec, label in zip(specs, labels) for i, seed in enumerate(seeds)
    ]
    grid = spark.createDataFrame(rows, "dataset string, method string, spec string, seed bigint, replicate int")
    if done is not None:
        grid = grid.join(done.select("dataset", "method", "seed"), ["dataset", "method", "seed"], "left_anti").select(*grid.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in RESULT.split(", ")]
        for batch in batches:
            out = []
            for t in batch.itertuples():
                spec = json.loads(t.spec)
                try:
                    r = method_from_dict(spec).solve(DenseGraph.unpacked(*shared.value[t.dataset]), k, theta, t.seed)
                    out.append((t.dataset, t.method, json.dumps(spec.get("params", {})), t.seed, t.replicate, r.edges, r.missing, len(r.us), len(r.vs),
                                r.theta_feasible, r.k_valid, r.wall_time_s, r.time_to_best_s, r.us, r.vs, json.dumps(r.meta["epoch_trace"]), "ok"))
                except Exception as error:  # noqa: BLE001 - the other runs go on; this one has a status and no measures
                    out.append((t.dataset, t.method, json.dumps(spec.get("params", {})), t.seed, t.replicate, *[None] * 11, f"error: {error or type(error).__name__}"))
            yield pd.DataFrame(out, columns=columns, dtype=object)

    tasks = max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism))
    found = grid.repartition(tasks, "dataset", "method", "seed").mapInPandas(run, RESULT)
    if now:
        found = materialize(found, "runs")
        shared.unpersist()
    return found


def exact_parallel(g: DenseGraph, k: int, theta: int, spark, incumbent: Solution | None = None, wave: int | None = None) -> Solution:
    """The exact search with its roots spread over tasks, in waves that share the best found so far."""
    best = incumbent if incumbent is not None else sto.tabu(g, k, theta)
    ship(spark)
    size = wave or 16 * spark.sparkContext.defaultParallelism
    data = spark.sparkContext.broadcast(g.packed())
    for start in range(0, g.n_u, size):
        roots = list(range(start, min(start + size, g.n_u)))
        floor = best.edges(g) if best.feasible(theta) and best.missing(g) <= k else 0
        tasks = max(1, min(len(roots), 4 * spark.sparkContext.defaultParallelism))
        frame = spark.createDataFrame([(r,) for r in roots], "root int").repartition(tasks, "root")

        def run(batches: Iterator[pd.DataFrame], floor: int = floor) -> Iterator[pd.DataFrame]:
            graph = DenseGraph.unpacked(*data.value)
            for batch in batches:
                found, _ = det.exact(graph, k, theta, roots=batch["root"].tolist(), floor=floor)
                yield pd.DataFrame([(s.edges(graph), s.us.tolist(), s.vs.tolist()) for s in found], columns=["edges", "us", "vs"])

        rows = frame.mapInPandas(run, "edges bigint, us array<bigint>, vs array<bigint>").collect()  # at most one row a task
        for r in sorted(rows, key=lambda r: (-r["edges"], r["us"])):
            best = better(g, best, Solution.of(r["us"], r["vs"]), theta)
    return best


def compare_seeds(g: DenseGraph, k: int, theta: int, seed: int = 0, deadline_s: float | None = None, ants: int = 20, spark=None) -> list[tuple]:
    """(seed method, its edges, edges of the exact search from it, whether that was complete) for both seeds.

    The first bound of the search is the theta heuristic's solution or an ant
    colony's; each search has the same time limit. With ``spark`` and no limit the
    searches run in waves of tasks.
    """
    rows = []
    seeds = {
        "heuristic": lambda: repaired(g, det.theta_heuristic(g, k, theta), k, theta),
        "aco": lambda: sto.ant_colony(g, k, theta, seed, ants, 3, greedy_fill="end"),
    }
    for name, make in seeds.items():
        first = make() if g.n_u and g.n_v else Solution.empty()
        if spark is not None and deadline_s is None:
            best = exact_parallel(g, k, theta, spark, first)
            rows.append((name, first.edges(g), best.edges(g) if best.feasible(theta) else 0, True))
            continue
        limit = None if deadline_s is None else time.monotonic() + deadline_s
        found, full = det.exact(g, k, theta, first, deadline=limit)
        rows.append((name, first.edges(g), found[0].edges(g) if found else 0, full))
    return rows
