"""Cells of reports: numbers, shares, verdicts. Null and NaN are drawn as `--`."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, places: int) -> Column:
    """A number with so many decimals, rounded half to even on its exact binary value (the JVM's formatter rounds its shortest decimal form half up)."""
    write = F.pandas_udf(lambda x: x.map(lambda v: None if pd.isna(v) else f"{v:.{places}f}"), "string")
    return write(value.cast("double"))


def _or_dashes(value: Column, text: Column) -> Column:
    return F.when(value.isNull() | F.isnan(value.cast("double")), F.lit("--")).otherwise(text)


def percent(value: Column, places: int = 1) -> Column:
    return _or_dashes(value, fixed(value * 100.0, places))


def fraction(value: Column, places: int = 3) -> Column:
    return _or_dashes(value, fixed(value, places))


def signed(value: Column, places: int = 1) -> Column:
    """With a sign, a true minus for negative numbers."""
    size = fixed(F.abs(value.cast("double")), places)
    return _or_dashes(value, F.concat(F.when(value < 0, F.lit("−")).otherwise(F.lit("+")), size))


def half_up(value: Column, places: int = 3) -> Column:
    return _or_dashes(value, F.round(value.cast("decimal(38,18)"), places).cast(f"decimal(38,{places})").cast("string"))


def ordinal(n: Column) -> Column:
    tens, ones = F.pmod(n, F.lit(100)), F.pmod(n, F.lit(10))
    suffix = F.when(tens.between(11, 13), "th").when(ones == 1, "st").when(ones == 2, "nd").when(ones == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def csv_cell(value: Column) -> Column:
    """NaN and null become empty, other numbers get four decimals."""
    return F.when(value.isNull() | F.isnan(value), F.lit("")).otherwise(fixed(value, 4))


def blank_to_double(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def p_value(p: Column) -> Column:
    """Two significant digits below 0.001, else four decimals without trailing zeros."""
    write = F.pandas_udf(lambda x: x.map(lambda v: None if pd.isna(v) else f"{v:.2g}" if v < 0.001 else f"{v:.4f}".rstrip("0").rstrip(".") if v < 1 else "1.0"), "string")
    return _or_dashes(p, write(p.cast("double")))


def milliseconds(value: Column) -> Column:
    """Whole milliseconds with thousands separators."""
    return _or_dashes(value, F.format_number(F.bround(value.cast("double")), 0))


def condition_label(condition: Column) -> Column:
    return F.when(condition == "clean", condition).otherwise(F.concat(condition, F.lit(" dB")))


def budget_verdict(p95: Column, budget: Column, n: Column) -> Column:
    return F.when(budget.isNull() | (n == 0) | p95.isNull(), "").when(p95 <= budget, "MEETS").otherwise("MISSES")


def interval_verdict(lo: Column, hi: Column, budget: Column) -> Column:
    return F.when(hi <= budget, "Met").when(lo > budget, "Missed").otherwise("Not demonstrated")
