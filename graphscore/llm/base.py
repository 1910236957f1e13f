"""What several corpus operators share: staging tables, let-bindings, tokenising expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import shared_dir, staged

__all__ = ["ascii_lower", "checked", "lean", "let", "shared_dir", "staged", "words"]

#: Regular expression of the six ASCII white-space characters, the only ones that part words.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows and bytes of the Arrow batches in which texts go to Python workers.
ARROW_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def lean(df: DataFrame) -> DataFrame:
    """``df``, for mapInArrow: where the session has Spark's defaults, its Arrow batches are made smaller, as those hold 10,000 texts of any length, on both sides."""
    conf = df.sparkSession.conf
    for key, (default, ours) in ARROW_LIMITS.items():
        if conf.get(key, default) == default:
            conf.set(key, ours)
    return df


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` evaluated once, however often (or deep inside other lambdas) it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words parted by ASCII white space, unchanged; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


#: Rows and bytes up to which a side is broadcast; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 16_000_000


def checked(side: DataFrame, row_bytes: int) -> DataFrame:
    """``side`` with a broadcast hint if a count proves it small, else as it is. Stage it first: counting runs it."""
    n = side.count()
    return F.broadcast(side) if n <= BROADCAST_ROWS and n * row_bytes <= BROADCAST_BYTES else side
