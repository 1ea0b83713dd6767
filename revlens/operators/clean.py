"""Cleaning operators F1–F4."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from revlens.functions.keys import coerce_numeric_key


RULE = "_rule"


def drop_null(df: DataFrame, cols: Iterable[str]) -> DataFrame:
    """drop rows whose key is missing."""
    return df.na.drop(subset=list(cols))


def drop_zero_key(df: DataFrame, col: str = "userid") -> DataFrame:
    """customer 0 is not a customer."""
    return df.where(F.col(col) != 0)


def _coerced(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``df`` with the keys coerced and ``_rule``, the first cleaning rule that
    the row fails in the order drop-null, coerce, ... of F4, NULL if none."""
    failed = []
    for k in keys:
        failed += [F.when(F.col(k).isNull(), F.lit(f"null {k}")),
                   F.when(F.col(f"_{k}").isNull(), F.lit(f"{k} is no number"))]
    failed.append(F.when(F.col(f"_{keys[-1]}") == 0, F.lit(f"zero {keys[-1]}")))
    judged = df.withColumns({f"_{k}": coerce_numeric_key(df, k) for k in keys}).withColumn(RULE, F.coalesce(*failed))
    return judged.withColumns({k: F.col(f"_{k}") for k in keys}).drop(*[f"_{k}" for k in keys])


def rule_names(keys: tuple[str, ...] = ("id", "userid")) -> list[str]:
    """The cleaning rules in their order."""
    return [n for k in keys for n in (f"null {k}", f"{k} is no number")] + [f"zero {keys[-1]}"]


def clean_keys_observed(df: DataFrame, feed: str,
                        keys: tuple[str, ...] = ("id", "userid")) -> tuple[DataFrame, Observation]:
    """``clean_keys`` and how many rows each rule drops, counted in the same
    pass: after the first action on the result, the observation holds ``rows``,
    ``kept`` and a count for each of ``rule_names``, which add up."""
    seen = Observation(f"cleaning {feed}")
    judged = _coerced(df, keys)
    counts = [F.count_if(F.col(RULE) == n).alias(n) for n in rule_names(keys)]
    judged = judged.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(F.col(RULE).isNull()).alias("kept"), *counts)
    return judged.where(F.col(RULE).isNull()).drop(RULE), seen


def cleaning_counts(df: DataFrame, keys: tuple[str, ...] = ("id", "userid")) -> DataFrame:
    """``rule, n_rows``: rows by the first rule that they fail, ``kept`` for the
    others."""
    return (_coerced(df, keys).groupBy(F.coalesce(RULE, F.lit("kept")).alias("rule"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


def clean_keys(df: DataFrame, keys: tuple[str, ...] = ("id", "userid")) -> DataFrame:
    """drop-null -> coerce-to-number -> drop-null for each key, then drop
    customer 0.  One projection plus one filter; both push into the scan."""
    out = df.withColumns({k: coerce_numeric_key(df, k) for k in keys})
    cond = None
    for k in keys:
        c = F.col(k).isNotNull()
        cond = c if cond is None else cond & c
    return drop_zero_key(out.where(cond), keys[-1])


def paid_only(df: DataFrame) -> DataFrame:
    """F8: paid invoices."""
    return df.where(F.col("status") == "Paid")
