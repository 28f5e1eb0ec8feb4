"""python -m bipartiq COMMAND: solve, sweep and compare methods on edge files, reduce and index graphs."""

from __future__ import annotations

import argparse
import itertools
import json

from pyspark.sql import DataFrame, SparkSession

from bipartiq import methods
from bipartiq.operators import reduction, relational
from bipartiq.sources import edges as sources


def _session(args: argparse.Namespace) -> SparkSession:
    builder = SparkSession.builder.appName("bipartiq").config("spark.sql.session.timeZone", "UTC")
    return (builder.master(args.master) if args.master else builder).getOrCreate()


def _graph(spark: SparkSession, args: argparse.Namespace, path: str) -> DataFrame:
    read = sources.read_edge_parquet if path.endswith(".parquet") else sources.read_edge_csv
    edges = read(spark, path)
    if args.inject:
        n_u, n_v = (int(x) for x in args.inject.split("x"))
        edges = relational.plant(edges, n_u, n_v, args.k, args.seed).select("u", "v")
    return edges


def _values(text: str) -> list:
    """A setting's values: "a,b,c", or "low:step:high" for numbers."""
    if text.count(":") == 2:
        low, step, high = (float(x) for x in text.split(":"))
        found, now = [], low
        while now <= high + 1e-9:
            found.append(int(now) if now == int(now) else round(now, 9))
            now += step
        return found
    return [json.loads(x) if x.replace(".", "", 1).lstrip("-").isdigit() or x in ("true", "false", "null") else x for x in text.split(",")]


def grid_specs(method: str, settings: dict[str, list]) -> list[dict]:
    """One method spec per combination of settings."""
    names = sorted(settings)
    combos = itertools.product(*(settings[n] for n in names))
    return [{"method": method, "label": " ".join([method, *(f"{n}={v}" for n, v in zip(names, c))]), "params": dict(zip(names, c))} for c in combos]


def run_suite(spark: SparkSession, graphs: dict[str, DataFrame], config: dict, out: str | None = None) -> DataFrame:
    """A suite as a settings file describes it: k, theta, seed, reduction, methods with replicates.

    Rows that ``out`` holds already aren't run again; new ones are added to it.
    """
    specs = config.get("methods") or [config["baseline"], config["challenger"]]
    seeds = [config.get("seed", 1) + r for r in range(max(int(s.get("replicates", 1)) for s in specs))]
    plain = [{k: v for k, v in s.items() if k != "replicates"} for s in specs]
    done = sources.completed(spark, out, ["dataset", "method", "seed"]) if out else None
    mode = {"lo": "simple", "hi": "all_reductions"}.get(config.get("reduction", "lo"), config.get("reduction", "lo"))
    rows = methods.run_grid(graphs, plain, config["k"], config["theta"], seeds, mode, done)
    if out:
        sources.append_results(rows, out)
        return spark.read.parquet(out)
    return rows


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="bipartiq", description=__doc__)
    parser.add_argument("--master", help="Spark master; default: the session's own")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, text in (("solve", "one method"), ("sweep", "a method over settings"), ("suite", "a settings file"), ("reduce", "reduce and write"), ("index", "dense ids")):
        c = commands.add_parser(name, help=text)
        c.add_argument("edges", nargs="+", help="edge files (.csv or .parquet)")
        c.add_argument("--k", type=int, default=2)
        c.add_argument("--theta", type=int, default=5)
        c.add_argument("--seed", type=int, default=1)
        c.add_argument("--reduction", default="simple", choices=list(reduction.REDUCTIONS))
        c.add_argument("--inject", help="UxV: plant such a block first")
        c.add_argument("--out", help="folder for the result")
        if name in ("solve", "sweep"):
            c.add_argument("--method", default="aco")
            c.add_argument("--set", action="append", default=[], metavar="NAME=VALUES")
            c.add_argument("--runs", type=int, default=1)
        if name == "suite":
            c.add_argument("--config", required=True)
    args = parser.parse_args(argv)
    spark = _session(args)
    graphs = {path: _graph(spark, args, path) for path in args.edges}
    if args.command == "reduce":
        for path, edges in graphs.items():
            sources.write_edge_csv(reduction.reduce_graph(edges, args.k, args.theta, args.reduction), args.out or path + ".reduced")
        return 0
    if args.command == "index":
        for path, edges in graphs.items():
            indexed, users, items = sources.index_dataset(edges, "u", "v")
            for part, df in (("edges", indexed), ("users", users), ("items", items)):
                df.write.parquet(f"{args.out or path + '.indexed'}/{part}")
        return 0
    if args.command == "suite":
        with open(args.config) as f:
            rows = run_suite(spark, graphs, json.load(f), args.out)
    else:
        settings = {n: _values(v) for n, v in (s.split("=", 1) for s in args.set)}
        specs = grid_specs(args.method, settings)
        rows = methods.run_grid(graphs, specs, args.k, args.theta, [args.seed + r for r in range(args.runs)], args.reduction)
        if args.out:
            sources.append_results(rows, args.out)
            rows = spark.read.parquet(args.out)
    rows.select("dataset", "method", "seed", "edges", "missing", "n_u", "n_v", "theta_feasible", "k_valid", "wall_time_s", "status").orderBy("dataset", "method", "seed").show(1000, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
