"""Typed errors of expressions: static ones are raised while planning, the others by the first bad row. A code is named where its check is."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

class ExpressionError(ValueError):
    def __init__(self, code: str, detail: str):
        super().__init__(f"{code}: {detail}")
        self.code = code


def failing(code: str, detail: str, like: Column | None = None) -> Column:
    """A value that fails the job when a row reaches it."""
    return F.raise_error(F.lit(f"{code}: {detail}"))


def guarded(ok: Column, value: Column, code: str, detail: str) -> Column:
    """The value where `ok` is true; elsewhere the row fails. The order of CASE branches is kept by Spark."""
    return F.when(ok, value).otherwise(failing(code, detail))


def quarantined(ok: Column, value: Column, code: str) -> Column:
    """The lenient form: (value, error) with the code instead of a failure."""
    return F.struct(F.when(ok, value).alias("value"), F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)).alias("error"))
