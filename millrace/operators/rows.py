"""Rows chosen by a predicate in the expression language."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.compile import Env, Lambda, compile_text, need
from ..plans.types import Maybe
from .aggregate import row_value


def where(df: DataFrame, m: Maybe | None, predicate: str) -> DataFrame:
    """Rows for which a function from the row to BOOL holds; a NULL result keeps nothing.

    The predicate is compiled to a Column, so that comparisons of plain columns reach the files.
    """
    row = row_value(df, m)
    f = compile_text(predicate, Env())
    need(isinstance(f, Lambda) and len(f.params) == 1, "a predicate is a function of the row")
    got = f(row)
    need(got.kind == "bool", f"a predicate is BOOL, not {got.mn}")
    return df.where(got.col)
