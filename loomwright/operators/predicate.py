"""The where-input algebra: nested dictionaries to Columns, and edges to semi and anti joins.

A key is a field with a suffix (none: equal). Several keys of one dictionary are AND-ed; ``and``, ``or`` and ``not`` nest.
``has<Edge>: bool`` asks whether a related row exists, ``has<Edge>With: [where...]`` whether one matches; edges nest.
Predicates stay Columns, so parquet filters see them; an edge under ``or`` or ``not`` becomes a marker of a left join.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Edge:
    """``left`` column of the owner equals ``right`` column of the target table."""

    target: str
    left: str
    right: str
    unique: bool = False
    required: bool = False


#: Longest suffix first, so that ``NotIn`` isn't read as ``In``.
SUFFIXES: dict[str, Callable[[Column, object], Column]] = {
    "ContainsFold": lambda c, v: F.lower(c).contains(str(v).lower()),
    "HasPrefix": lambda c, v: c.startswith(v),
    "HasSuffix": lambda c, v: c.endswith(v),
    "EqualFold": lambda c, v: F.lower(c) == str(v).lower(),
    "Contains": lambda c, v: c.contains(v),
    "NotNil": lambda c, v: c.isNotNull() if v else F.lit(True),
    "IsNil": lambda c, v: c.isNull() if v else F.lit(True),
    "NotIn": lambda c, v: ~c.isin(list(v)),
    "NEQ": lambda c, v: c != v,
    "GTE": lambda c, v: c >= v,
    "LTE": lambda c, v: c <= v,
    "GT": lambda c, v: c > v,
    "LT": lambda c, v: c < v,
    "In": lambda c, v: c.isin(list(v)),
    "": lambda c, v: c == v,
}


class Relations:
    """Tables by name and edges by (table, edge name)."""

    def __init__(self, tables: dict[str, DataFrame], edges: dict[tuple[str, str], Edge]):
        self.tables, self.edges = tables, edges

    def field(self, table: str, key: str) -> tuple[str, str]:
        names = {c.lower(): c for c in self.tables[table].columns}
        for suffix in SUFFIXES:
            stem = key[: len(key) - len(suffix)] if suffix else key
            if key.endswith(suffix) and stem.lower() in names:
                return names[stem.lower()], suffix
        raise KeyError(f"no field or edge {key!r} in {table}")

    def edge(self, table: str, key: str) -> tuple[Edge, bool] | None:
        if not key.startswith("has"):
            return None
        for (owner, name), e in self.edges.items():
            if owner == table and key in (f"has{name}", f"has{name}With"):
                return e, key.endswith("With")
        return None

    def column(self, table: str, where: dict) -> Column:
        """A predicate without edges."""
        parts = [F.lit(True)]
        for key, value in where.items():
            if key == "and":
                parts += [self.column(table, w) for w in value]
            elif key == "or":
                parts.append(reduce(lambda a, b: a | b, [self.column(table, w) for w in value], F.lit(False)))
            elif key == "not":
                parts.append(~self.column(table, value))
            else:
                name, suffix = self.field(table, key)
                parts.append(SUFFIXES[suffix](F.col(f"`{name}`"), value))
        return reduce(lambda a, b: a & b, parts[1:] or parts)

    def has_edges(self, table: str, where: dict) -> bool:
        return any(any(self.has_edges(table, w) for w in v) if k in ("and", "or") else self.has_edges(table, v) if k == "not" else self.edge(table, k) is not None for k, v in where.items())

    def related(self, e: Edge, wheres: list[dict]) -> DataFrame:
        child = self.tables[e.target]
        for w in wheres:
            child = self.filter(e.target, w, child)
        return child.select(F.col(f"`{e.right}`").alias("__edge"))

    def filter(self, table: str, where: dict, df: DataFrame | None = None) -> DataFrame:
        """Rows of the table that match."""
        df = self.tables[table] if df is None else df
        plain = {k: v for k, v in where.items() if not self.has_edges(table, {k: v})}
        df = df.where(self.column(table, plain)) if plain else df
        for key, value in where.items():
            if key in plain:
                continue
            if key == "and":
                for w in value:
                    df = self.filter(table, w, df)
            elif key in ("or", "not"):
                df = self._marked(table, {key: value}, df)
            else:
                e, with_ = self.edge(table, key)
                child = self.related(e, value if with_ else [])
                df = df.join(child, df[e.left] == child["__edge"], "left_semi" if with_ or value else "left_anti")
        return df

    def _marked(self, table: str, where: dict, df: DataFrame) -> DataFrame:
        """Edges inside or / not: each becomes a boolean from a left join with its distinct keys."""
        columns, marks = df.columns, []

        def walk(w: dict) -> Column:
            nonlocal df
            out = F.lit(True)
            for k, v in w.items():
                if k == "and":
                    c = reduce(lambda a, b: a & b, [walk(x) for x in v], F.lit(True))
                elif k == "or":
                    c = reduce(lambda a, b: a | b, [walk(x) for x in v], F.lit(False))
                elif k == "not":
                    c = ~walk(v)
                elif (found := self.edge(table, k)) is not None:
                    e, with_ = found
                    mark = f"__mark{len(marks)}"
                    marks.append(mark)
                    child = self.related(e, v if with_ else []).distinct().withColumnRenamed("__edge", mark)
                    df = df.join(child, df[e.left] == child[mark], "left")
                    c = F.col(mark).isNotNull() if with_ or v else F.col(mark).isNull()
                else:
                    c = self.column(table, {k: v})
                out = out & c
            return out

        condition = walk(where)
        return df.where(condition).select(*columns)

    def count_edge(self, table: str, edge: str, df: DataFrame, name: str) -> DataFrame:
        """df with the number of related rows (0 where none)."""
        e = self.edges[table, edge]
        counts = self.tables[e.target].groupBy(F.col(f"`{e.right}`").alias("__edge")).agg(F.count("*").alias(name))
        return df.join(counts, df[e.left] == counts["__edge"], "left").drop("__edge").withColumn(name, F.coalesce(name, F.lit(0)))

    def parent(self, table: str, edge: str, df: DataFrame, columns: dict[str, str]) -> DataFrame:
        """Many-to-one fetch: df with columns of the one related row, null where there is none."""
        e = self.edges[table, edge]
        one = self.tables[e.target].select(F.col(e.right).alias("__edge"), *[F.col(c).alias(a) for c, a in columns.items()])
        return df.join(one, df[e.left] == one["__edge"], "left").drop("__edge")

    def children(self, table: str, edge: str, df: DataFrame, first: int, order: list[Column], where: dict | None = None) -> DataFrame:
        """The first children of each row in an order, with ``rank``; Spark prunes ranks before the shuffle (window group limit)."""
        from pyspark.sql import Window

        e = self.edges[table, edge]
        child = self.filter(e.target, where or {})
        ranked = child.withColumn("rank", F.row_number().over(Window.partitionBy(e.right).orderBy(*order))).where(F.col("rank") <= first)
        return df.join(ranked, df[e.left] == ranked[e.right], "inner")
