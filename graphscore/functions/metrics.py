"""Ratios and confusion metrics; null-safe, and 0 where nothing was counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(n: Column, d: Column) -> Column:
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def with_scores(df: DataFrame, precision: str = "precision", recall: str = "recall", f1: str | None = "f1") -> DataFrame:
    """``df`` (tp, fp, fn) with precision, recall and their harmonic mean."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = df.withColumns({precision: p, recall: r})
    if f1:
        a, b = F.col(precision), F.col(recall)
        out = out.withColumn(f1, ratio(2 * a * b, a + b))
    return out


def is_scoreable(flag: Column) -> Column:
    """Absent counts as scoreable."""
    return F.coalesce(flag, F.lit(True))


def derived_scoreable(edges: DataFrame) -> DataFrame:
    """Rows of the compared types that don't say whether they can be scored can if their target is known."""
    from ..schemas import EDGE_TYPES

    known = F.coalesce(F.col("targetLocalId"), F.lit("")) != ""
    return edges.withColumn("scoreable", F.coalesce("scoreable", F.when(F.col("type").isin(*EDGE_TYPES), known)))
