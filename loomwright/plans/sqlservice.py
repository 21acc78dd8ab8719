"""The SQL query service: validation, parameters, lineage, column permissions and pages. The dialect is Spark SQL."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime
from decimal import Decimal

from py4j.java_gateway import is_instance_of
from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomwright.operators.paging import clamp, decode_token, encode_token

DIALECT = "SparkSQL"
CATALYST = "org.apache.spark.sql.catalyst"
#: Leaves of a plan that read no table.
TABLELESS = {"OneRowRelation", "LocalRelation", "Range", "CTERelationRef"}


@dataclass
class Query:
    """The answer to a validation."""

    query: str
    valid: bool
    error: str = ""
    dialect: str = DIALECT
    params: dict = field(default_factory=dict)
    fields: list[tuple[str, str, bool]] = field(default_factory=list)
    accessed: dict[str, set[str]] = field(default_factory=dict)
    param_types: dict[str, str] = field(default_factory=dict)


@dataclass
class ResultPage:
    """A page of a query's rows; an empty token means that there is no page on that side."""

    fields: list[tuple[str, str, bool]]
    rows: list[Row]
    next_token: str
    previous_token: str
    total_rows: int
    total_pages: int


def items(seq) -> list:
    """The elements of a Scala Seq."""
    return [seq.apply(i) for i in range(seq.size())]


class PlanReader:
    """Reads the analyzed plan: what it refers to, before anything is pruned, in subqueries too."""

    def __init__(self, spark: SparkSession):
        self.gateway = spark.sparkContext._gateway

    def isa(self, obj, name: str) -> bool:
        return is_instance_of(self.gateway, obj, f"{CATALYST}.{name}")

    def inside(self, expression) -> list:
        """The plans of the subqueries in an expression."""
        out, work = [], [expression]
        while work:
            e = work.pop()
            if self.isa(e, "expressions.SubqueryExpression"):
                out.append(e.plan())
            work += items(e.children())
        return out

    def nodes(self, plan, descend=lambda node: True):
        """All nodes, also of subqueries; below a node only if descend says so."""
        work = [plan]
        while work:
            node = work.pop()
            yield node
            if descend(node):
                work += items(node.children())
                for e in items(node.expressions()):
                    work += self.inside(e)

    def accessed(self, plan, registered: set[str] | None = None) -> tuple[dict[str, set[str]], list[str]]:
        """(tables and the columns that the plan refers to, other relations). A table is a registered view (none given: any view)."""

        def is_table(node) -> bool:
            return self.isa(node, "plans.logical.View") and (registered is None or node.desc().identifier().table() in registered)

        owner, out, used, others = {}, {}, [plan.output()], []
        for node in self.nodes(plan, lambda n: not is_table(n)):
            if is_table(node):
                name = node.desc().identifier().table()
                out.setdefault(name, set())
                owner |= {a.exprId().id(): (name, a.name()) for a in items(node.output())}
            elif not node.children().size():
                kind = node.getClass().getSimpleName()
                if kind not in TABLELESS:
                    others.append(kind)
            else:
                used.append(node.references().toSeq())
        for attributes in used:
            for a in items(attributes):
                if (found := owner.get(a.exprId().id())) is not None:
                    out[found[0]].add(found[1])
        return out, others


def accessed(df: DataFrame) -> dict[str, set[str]]:
    """Tables (views) and the columns that a query refers to, subqueries included. It needs a session with a JVM at hand."""
    return PlanReader(df.sparkSession).accessed(df._jdf.queryExecution().analyzed())[0]


QUOTED = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/""", re.S)


def param_names(query: str) -> list[str]:
    """The names of a query's parameters (``:name``), in order, outside of texts and comments."""
    return list(dict.fromkeys(re.findall(r"(?<![:\w]):([A-Za-z_]\w*)", QUOTED.sub(" ", query))))


def typed(value, kind: str | None):
    """A parameter's value as a declared kind; a value that isn't one is an error."""
    if value is None or kind is None:
        return value
    if kind in ("INT32", "INT64", "UINT32", "UINT64"):
        if isinstance(value, bool) or int(value) != float(value):
            raise ValueError(f"{value!r} is no {kind}")
        if kind.startswith("U") and int(value) < 0 or kind.endswith("32") and abs(int(value)) >= 1 << (32 if kind[0] == "U" else 31):
            raise ValueError(f"{value!r} is out of the range of {kind}")
        return int(value)
    if kind == "BOOL":
        if str(value).lower() not in ("true", "false"):
            raise ValueError(f"{value!r} is no BOOL")
        return str(value).lower() == "true"
    convert = {"DOUBLE": float, "FLOAT": float, "STRING": str, "DECIMAL": lambda v: Decimal(str(v)), "TIMESTAMP": lambda v: v if isinstance(v, datetime) else datetime.fromisoformat(v), "BYTES": lambda v: v if isinstance(v, bytes) else str(v).encode()}
    return convert[kind](value)


def kind_of(value) -> str:
    return next((k for t, k in ((bool, "BOOL"), (int, "INT64"), (float, "DOUBLE"), (str, "STRING"), (datetime, "TIMESTAMP"), (Decimal, "DECIMAL"), (bytes, "BYTES")) if isinstance(value, t)), "ANY")


def plain_error(e: Exception) -> str:
    return str(e).split("\n")[0]


class SqlService:
    """Tables are temporary views; ``accessible`` is table -> columns (or column -> alias); none means everything.

    Only queries run: a command (DDL, INSERT, SET) is refused before it is analyzed. With ``accessible``, a query may read no
    relation but the registered views, and of these no column that the list lacks, wherever it names it.
    """

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], accessible: dict | None = None):
        self.spark, self.accessible, self.tables, self.reader = spark, accessible, set(tables), PlanReader(spark)
        for name, df in tables.items():
            df.createOrReplaceTempView(name)

    def analyzed(self, query: str, params: dict | None = None, types: dict[str, str] | None = None, missing: bool = False) -> DataFrame:
        """The query as a DataFrame; missing parameters are an error, or null."""
        parsed = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
        for node in self.reader.nodes(parsed):
            if self.reader.isa(node, "plans.logical.Command") or self.reader.isa(node, "plans.logical.ParsedStatement") or node.getClass().getSimpleName().startswith("Compound"):
                raise ValueError("only queries can be run")
        types, names = types or {}, param_names(query)
        given = {n: typed((params or {}).get(n), types.get(n)) for n in names if missing or n in (params or {})}
        return self.spark.sql(query, args=given)

    def validate(self, query: str, params: dict | None = None, types: dict[str, str] | None = None) -> Query:
        """Analyze without running; problems of permission count as errors. Parameters without a value are null here."""
        params, types = params or {}, types or {}
        kinds = {n: types.get(n) or (kind_of(params[n]) if n in params else "ANY") for n in param_names(query)}
        try:
            df = self.analyzed(query, params, types, missing=True)
        except (AnalysisException, ParseException, ValueError) as e:
            return Query(query, False, plain_error(e), params=params, param_types=kinds)
        found, others = self.reader.accessed(df._jdf.queryExecution().analyzed(), self.tables)
        denied = self.denied(found, others)
        return Query(query, not denied, "; ".join(denied), params=params, fields=fields_of(df), accessed=found, param_types=kinds)

    def denied(self, found: dict[str, set[str]], others: list[str]) -> list[str]:
        if self.accessible is None:
            return []
        out = [f"{kind} is not a registered table" for kind in others] + [f"table {t} is not accessible" for t in found if t not in self.accessible]
        return out + [f"column {t}.{c} is not accessible" for t, cs in found.items() if t in self.accessible for c in sorted(cs - set(self.accessible[t]))]

    def run(self, query: str, params: dict | None = None, types: dict[str, str] | None = None) -> DataFrame:
        df = self.analyzed(query, params, types)
        if self.accessible is not None and (denied := self.denied(*self.reader.accessed(df._jdf.queryExecution().analyzed(), self.tables))):
            raise PermissionError("; ".join(denied))
        return df

    def stream(self, query: str, params: dict | None = None, types: dict[str, str] | None = None) -> Iterator[Row]:
        """Rows one after the other; one partition at a time is fetched."""
        return self.run(query, params, types).toLocalIterator(prefetchPartitions=True)

    def page(self, query: str, params: dict | None = None, size: int | None = None, token: str = "", types: dict[str, str] | None = None) -> ResultPage:
        """A page of the rows, with tokens for the pages around it and totals.

        A query that ends in ORDER BY keeps its order, any other is sorted by all its columns, so that pages don't overlap.
        A token holds the place and the query that it belongs to.
        """
        df, n, mark = self.run(query, params, types), clamp(size), repr((query, sorted((params or {}).items())))
        at = 0
        if token:
            asked, at = decode_token(token)
            if asked != mark:
                raise ValueError("the token is of another query")
        ordered = self.reader.isa(df._jdf.queryExecution().analyzed(), "plans.logical.Sort")
        rows = (df if ordered else df.orderBy(*[F.col(f"`{c}`") for c in df.columns])).offset(at).limit(n + 1).collect()
        total = df.count()
        return ResultPage(fields_of(df), rows[:n], encode_token([mark, at + n]) if len(rows) > n else "", encode_token([mark, max(0, at - n)]) if at else "", total, -(-total // n))

    def canonical(self, query: str, params: dict | None = None) -> str:
        return self.analyzed(query, params)._jdf.queryExecution().analyzed().canonicalized().toString()

    def models(self, models: dict[str, str]) -> list[str]:
        """Create views in the order of their dependencies, the relations that their parsed queries name; returns that order."""
        parser, needs = self.spark._jsparkSession.sessionState().sqlParser(), {}
        for m, q in models.items():
            named = {items(n.multipartIdentifier())[-1] for n in self.reader.nodes(parser.parsePlan(q)) if self.reader.isa(n, "analysis.UnresolvedRelation")}
            needs[m] = named & set(models) - {m}
        done: list[str] = []
        while len(done) < len(models):
            ready = [m for m in models if m not in done and needs[m] <= set(done)]
            if not ready:
                raise ValueError("cycle of models")
            for m in ready:
                self.spark.sql(models[m]).createOrReplaceTempView(m)
                done.append(m)
        return done


def fields_of(df: DataFrame) -> list[tuple[str, str, bool]]:
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]


def expose(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Only the permitted columns, under their aliases."""
    return df.select(*[F.col(f"`{c}`").alias(a or c) for c, a in columns.items()])
