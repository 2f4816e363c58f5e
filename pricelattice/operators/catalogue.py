"""Walks of catalogue tables: categories, their groups, their series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def walk(nodes: DataFrame, root: str | None = None, depth: int = 16) -> DataFrame:
    """parent, code, name, kind, level (0 for roots), path (names joined by ' / ') of what lies below a root code, or below all roots
    (nodes without a parent). A recursive query over the table of nodes (parent, code, name, kind); it ends at `depth` levels, so a circle
    in the table cannot hold it up."""
    spark = nodes.sparkSession
    start = "code = :root" if root is not None else "parent is null"
    sql = f"""
        with recursive tree(parent, code, name, kind, level, path) max recursion level {depth} as (
            select parent, code, name, kind, 0, name from {{nodes}} where {start}
            union all
            select n.parent, n.code, n.name, n.kind, t.level + 1, concat(t.path, ' / ', n.name) from tree t join {{nodes}} n on n.parent = t.code where t.level + 1 < {depth})
        select * from tree"""
    args = {"root": root} if root is not None else None
    return spark.sql(sql, args=args, nodes=nodes.select("parent", "code", "name", "kind"))


def series_of(nodes: DataFrame, root: str | None = None, kind: str = "series") -> DataFrame:
    """The leaves of a walk: code, name, path."""
    return walk(nodes, root).filter(F.col("kind") == kind).select("code", "name", "path")
