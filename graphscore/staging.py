"""Intermediate tables as Parquet in the folder that all executors share: they cut lineage and outlive lost executors."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where that is unset, one of our own in local mode, as in tests; on a cluster, an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    app, master = spark.sparkContext.applicationId, spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="corpus-")
    return _own[app]


def staged(df: DataFrame) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back. The files stay until the folder is emptied."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes up to which a side is broadcast.
_ROWS, _BYTES = 500_000, 16_000_000


def small(side: DataFrame) -> DataFrame:
    """``side`` (staged) with a broadcast hint if a count proves it small, else as it is."""
    texts = [F.coalesce(F.length(c), F.lit(0)) if t == "string" else F.lit(8) for c, t in side.dtypes]
    n, size = side.agg(F.count(F.lit(1)), F.sum(sum(texts, F.lit(16)))).first()
    return F.broadcast(side) if n <= _ROWS and (size or 0) <= _BYTES else side


def hashed_joins(spark: SparkSession) -> None:
    """Where the session doesn't say otherwise, joins whose smaller side comes in parts of some MB each look up a hash of it instead of sorting both sides."""
    key = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold"
    if spark.conf.get(key, "0b") in ("0", "0b"):
        spark.conf.set(key, "32m")


def at_once(*works: Callable, threads: int = 4) -> list:
    """What the functions return, called at the same time: while one job's last tasks run, others use the free cores. What two of them share has to be computed before."""
    with ThreadPoolExecutor(threads) as pool:
        return [f.result() for f in [pool.submit(w) for w in works]]
