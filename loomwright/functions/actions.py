"""Actions: named, typed row functions with checked input and output, usable in flows and SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from loomwright.types import constraint, from_json_schema


@dataclass(frozen=True)
class Action:
    name: str
    description: str
    input: dict
    output: dict
    run: Callable[[Column], Column]

    @property
    def slug(self) -> str:
        return "actions/" + "-".join(self.name.lower().split())


class Registry:
    def __init__(self):
        self.actions: dict[str, Action] = {}

    def add(self, name: str, description: str, input: dict, output: dict, run: Callable[[Column], Column]) -> Action:
        a = Action(name, description, input, output, run)
        if a.slug in self.actions:
            raise ValueError(f"{a.slug} exists")
        self.actions[a.slug] = a
        return a

    def find(self, name: str) -> Action:
        """By resource name or display name."""
        found = self.actions.get(name) or next((a for a in self.actions.values() if a.name == name), None)
        if found is None:
            raise KeyError(f"no action {name!r}")
        return found

    def call(self, name: str, value: Column) -> Column:
        """The result; input or output that breaks its schema is an error."""
        a = self.find(name)
        value = value.cast(from_json_schema(a.input))
        out = a.run(F.when(constraint(value, a.input), value).otherwise(F.raise_error(F.lit(f"bad input of {a.name}")).cast(from_json_schema(a.input))))
        kind = from_json_schema(a.output)
        return F.when(constraint(out, a.output), out.cast(kind)).otherwise(F.raise_error(F.lit(f"bad output of {a.name}")).cast(kind))

    def try_call(self, name: str, value: Column, on_error: Column) -> Column:
        """Input that breaks its schema, or can't be cast, gives on_error instead."""
        a = self.find(name)
        kind = from_json_schema(a.input)
        cast = value.try_cast(kind)
        return F.when(cast.isNotNull() & constraint(cast, a.input), a.run(cast).cast(from_json_schema(a.output))).otherwise(on_error)


def aggregate(function: Callable, kind: str) -> Callable:
    """A user aggregate: a function of pandas Series to one value, for ``groupBy().agg`` and windows; a group is one call."""
    import pandas as pd

    def run(values):
        return function(values)

    run.__annotations__ = {"values": pd.Series, "return": float if kind == "double" else int if kind in ("long", "bigint", "int") else str}
    return F.pandas_udf(run, kind)


def register_sql(spark: SparkSession, name: str, function) -> None:
    """A pandas function for SQL."""
    spark.udf.register(name, function)
