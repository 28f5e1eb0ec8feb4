"""Bipartite graphs as edge tables.

A graph is a DataFrame of distinct edges (u bigint, v bigint) with original ids.
Isolated vertices are rows of a vertex table (is_u boolean, id bigint), which
operators take as an argument of its own where they matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bipartiq.session import materialize


def edges_from(df: DataFrame, u: str, v: str) -> DataFrame:
    """Distinct edges from any two columns; rows with a null or non-numeric end are none."""
    return (
        df.select(F.col(u).cast("bigint").alias("u"), F.col(v).cast("bigint").alias("v"))
        .filter(F.col("u").isNotNull() & F.col("v").isNotNull())
        .distinct()
    )


def transpose(edges: DataFrame) -> DataFrame:
    """The graph with its sides swapped."""
    return edges.select(F.col("v").alias("u"), F.col("u").alias("v"))


def vertices(edges: DataFrame) -> DataFrame:
    """(is_u, id) of all ends of edges."""
    return edges.select(F.lit(True).alias("is_u"), F.col("u").alias("id")).unionByName(
        edges.select(F.lit(False).alias("is_u"), F.col("v").alias("id"))
    ).distinct()


@dataclass
class BipartiteGraph:
    """An immutable graph; changes give new graphs."""

    edges: DataFrame
    isolated: DataFrame | None = None

    @classmethod
    def from_table(cls, df: DataFrame, u: str, v: str) -> BipartiteGraph:
        return cls(edges_from(df, u, v))

    def vertices(self) -> DataFrame:
        found = vertices(self.edges)
        return found if self.isolated is None else found.unionByName(self.isolated).distinct()

    def persisted(self) -> BipartiteGraph:
        """The same graph, written once to the shared folder."""
        return BipartiteGraph(materialize(self.edges, "edges"), self.isolated)

    def add_edges(self, more: DataFrame) -> BipartiteGraph:
        return BipartiteGraph(self.edges.unionByName(edges_from(more, "u", "v")).distinct(), self.isolated)

    def remove_edges(self, gone: DataFrame) -> BipartiteGraph:
        """Without some edges; their ends stay as vertices."""
        return BipartiteGraph(self.edges.join(gone, ["u", "v"], "left_anti"), self.vertices())

    def remove_vertices(self, gone: DataFrame) -> BipartiteGraph:
        """Without some vertices (is_u, id) and all their edges."""
        left = gone.filter("is_u").select(F.col("id").alias("u"))
        right = gone.filter("NOT is_u").select(F.col("id").alias("v"))
        edges = self.edges.join(left, "u", "left_anti").join(right, "v", "left_anti").select("u", "v")
        return BipartiteGraph(edges, self.vertices().join(gone, ["is_u", "id"], "left_anti"))
