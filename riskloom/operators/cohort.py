"""Outcome flags and the cohort filters built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def is_eligible(cancelled: str = "Cancelled", diverted: str = "Diverted", outcome: str = "ArrDel15") -> Column:
    """Completed as planned and the outcome is known."""
    known = (F.col(cancelled) == 0) & (F.col(diverted) == 0) & F.col(outcome).isNotNull()
    return F.coalesce(known, F.lit(False)).cast("int")


def is_adverse(cancelled: str = "Cancelled", diverted: str = "Diverted", outcome: str = "ArrDel15") -> Column:
    hit = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    return (hit(cancelled) | hit(diverted) | hit(outcome)).cast("int")


def add_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({"adverse_operation": is_adverse(), "primary_eligible": is_eligible()})


def eligible(df: DataFrame, years: Sequence[int] | None = None, year: str = "year") -> DataFrame:
    """Eligible rows, of some years if given; prunes partitions when stored by year."""
    kept = df.where(F.col("primary_eligible") == 1)
    return kept if years is None else kept.where(F.col(year).isin(*years))


def temporal_split(
    df: DataFrame, fit_until: int, validate: int, test: int, year: str = "year"
) -> dict[str, DataFrame]:
    """Fit, validation and test parts by calendar year."""
    return {
        "fit": df.where(F.col(year) <= fit_until),
        "validate": df.where(F.col(year) == validate),
        "test": df.where(F.col(year) == test),
    }


def split_part(fit_until: int, validate: int, test: int, year: str = "year") -> Column:
    """The part a row belongs to, for work on all parts in one scan; NULL outside them."""
    return F.when(F.col(year) <= fit_until, "fit").when(F.col(year) == validate, "validate").when(F.col(year) == test, "test")
