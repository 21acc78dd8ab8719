"""Lists with a filter text, and message rules: CEL over the columns of a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.cel.compiler import Compiler, names_of
from loomwright.cel.parser import CelError


def filtered(df: DataFrame, text: str) -> DataFrame:
    """The rows for which a filter such as ``labels.team == 'a' && !disabled`` holds; an empty one keeps all.

    A label that a row doesn't have, or any other error, makes the filter false for it.
    """
    if not text.strip():
        return df
    compiler = Compiler(names_of(df.schema))
    compiler.safe = 1
    test = compiler.compile(text)
    if not isinstance(test.type, T.BooleanType):
        raise CelError("a filter is a bool")
    return df.where(F.coalesce(test.col, F.lit(False)))


def violations(df: DataFrame, rules: list[tuple[str, str, str]]) -> Column:
    """``id, message`` of the rules (id, message, expression) that a row breaks.

    An expression is a bool, true if the row is fine, or a text, empty if it is, which then is the message.
    """
    broken = []
    for rule, message, text in rules:
        v = Compiler(names_of(df.schema)).compile(text)
        if isinstance(v.type, T.StringType):
            fine, said = F.coalesce(v.col, F.lit("")) == "", v.col
        elif isinstance(v.type, T.BooleanType):
            fine, said = F.coalesce(v.col, F.lit(False)), F.lit(message)
        else:
            raise CelError(f"rule {rule} is neither a bool nor a text")
        broken.append(F.when(~fine, F.struct(F.lit(rule).alias("id"), said.alias("message"))))
    return F.filter(F.array(*broken), lambda b: b.isNotNull()) if broken else F.array().cast("array<struct<id:string,message:string>>")
