"""Order, keyset and offset pages, page sizes and page tokens."""

from __future__ import annotations

import base64
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Default, least and greatest page size; default limit and offset of a search.
DEFAULT_SIZE, LEAST_SIZE, MOST_SIZE = 10, 1, 100


def clamp(size: int | None, default: int = DEFAULT_SIZE, least: int = LEAST_SIZE, most: int = MOST_SIZE) -> int:
    """0 or none: the default; else within bounds."""
    return default if not size else max(least, min(most, size))


def encode_token(values: list) -> str:
    """An opaque cursor of sort values; timestamps as ISO text."""
    return base64.urlsafe_b64encode(json.dumps([v.isoformat() if hasattr(v, "isoformat") else v for v in values]).encode()).decode()


def decode_token(token: str) -> list:
    return json.loads(base64.urlsafe_b64decode(token.encode()))


def encode_uuid7(u: uuid.UUID) -> str:
    if u.version != 7:
        raise ValueError("page tokens need version 7 ids")
    return base64.b64encode(u.bytes).decode()


def decode_uuid7(token: str) -> uuid.UUID:
    u = uuid.UUID(bytes=base64.b64decode(token))
    if u.version != 7:
        raise ValueError("page tokens need version 7 ids")
    return u


@dataclass
class Page:
    rows: list
    next_token: str
    has_next: bool
    has_previous: bool


def order_columns(order: list[tuple[str, bool]], flip: bool = False) -> list[Column]:
    """Sort columns with nulls last; flipped, the reverse of that order, with nulls first."""
    cols = [(F.col(f"`{c}`"), desc) for c, desc in order]
    if flip:
        return [c.asc_nulls_first() if desc else c.desc_nulls_first() for c, desc in cols]
    return [c.desc_nulls_last() if desc else c.asc_nulls_last() for c, desc in cols]


def beyond(order: list[tuple[str, bool]], values: list, flip: bool = False) -> Column:
    """Rows strictly after the cursor (flipped: before it): a chain of equal prefixes and one strict comparison, which scans can use.

    Nulls come after all values, so a null is beyond every value, and nothing is beyond a null.
    """
    out, same = F.lit(False), F.lit(True)
    for (c, desc), v in zip(order, values, strict=True):
        col = F.col(f"`{c}`")
        if v is None:
            strict, equal = (col.isNotNull() if flip else F.lit(False)), col.isNull()
        else:
            less = col < F.lit(v)
            strict, equal = (less if desc != flip else col > F.lit(v)), col == F.lit(v)
            strict = strict if flip else strict | col.isNull()
        out = out | (same & strict)
        same = same & equal
    return out


def keyset(df: DataFrame, order: list[tuple[str, bool]], first: int | None = None, after: list | None = None, last: int | None = None, before: list | None = None) -> DataFrame:
    """A page after (first) or before (last) a cursor, as a DataFrame in page order; top-k, so no full sort is made."""
    back = last is not None
    cursor = before if back else after
    if cursor is not None:
        df = df.where(beyond(order, cursor, back))
    page = df.orderBy(*order_columns(order, back)).limit(clamp(last if back else first))
    return page.orderBy(*order_columns(order)) if back else page


def page(df: DataFrame, order: list[tuple[str, bool]], size: int | None = None, token: str = "") -> Page:
    """One page of rows with a token for the next; asks for one row more to know whether there is one."""
    n, after = clamp(size), decode_token(token) if token else None
    found = df if after is None else df.where(beyond(order, after))
    rows = found.orderBy(*order_columns(order)).limit(n + 1).collect()
    more = len(rows) > n
    rows = rows[:n]
    return Page(rows, encode_token([rows[-1][c] for c, _ in order]) if more else "", more, after is not None)


@dataclass
class Connection:
    """Edges (a cursor and a row each), what lies around them, and the count of all rows."""

    edges: list[tuple[str, object]]
    has_next: bool
    has_previous: bool
    total_count: int

    @property
    def start_cursor(self) -> str:
        return self.edges[0][0] if self.edges else ""

    @property
    def end_cursor(self) -> str:
        return self.edges[-1][0] if self.edges else ""


def connection(df: DataFrame, order: list[tuple[str, bool]], first: int | None = None, after: str = "", last: int | None = None, before: str = "") -> Connection:
    """A page of edges after (first) or before (last) a cursor; one row more is asked for to know whether there are more."""
    back, token = last is not None, before if last is not None else after
    n = clamp(last if back else first)
    found = df.where(beyond(order, decode_token(token), back)) if token else df
    rows = found.orderBy(*order_columns(order, back)).limit(n + 1).collect()
    more, rows = len(rows) > n, rows[:n]
    rows = rows[::-1] if back else rows
    edges = [(encode_token([r[c] for c, _ in order]), r) for r in rows]
    return Connection(edges, bool(token) if back else more, more if back else bool(token), df.count())


def uuid7_page(df: DataFrame, column: str, size: int | None = None, token: str = "") -> Page:
    """A page by descending version 7 ids (text); the next token is the last id, and is given only if the page is full."""
    n = clamp(size)
    found = df.where(F.col(column) < F.lit(str(decode_uuid7(token)))) if token else df
    rows = found.orderBy(F.col(column).desc_nulls_last()).limit(n).collect()
    return Page(rows, encode_uuid7(uuid.UUID(rows[-1][column])) if len(rows) == n else "", len(rows) == n, bool(token))


def numbered_page(df: DataFrame, order: list[tuple[str, bool]], size: int, number: int) -> DataFrame:
    """Page ``number`` (from 1) with ``total_rows`` and ``total_pages``.

    The total is one aggregate that is joined to the page, so no window gathers the table.
    """
    n = clamp(size)
    total = df.agg(F.count("*").alias("total_rows"))
    rows = df.orderBy(*order_columns(order)).offset((number - 1) * n).limit(n)
    return rows.join(F.broadcast(total.withColumn("total_pages", F.ceil(F.col("total_rows") / n).cast("long"))))


def offset_page(df: DataFrame, order: list[tuple[str, bool]], limit: int = 10, offset: int = 0) -> DataFrame:
    return df.orderBy(*order_columns(order)).offset(offset).limit(limit)


def with_rank(df: DataFrame, by: list[str], order: list[tuple[str, bool]]) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order_columns(order))))
