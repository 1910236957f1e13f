"""Edges that arrive as files: a streaming ingest into the engine's table, to be scored again as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schemas import EDGES


def edge_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Edge rows (JSON lines, with tool and ord) of files that appear in ``folder``."""
    return spark.readStream.schema(EDGES).option("mode", "FAILFAST").json(folder)


def ingest(edges: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Appends ``edges`` to the Parquet table ``table``, each file once, and stops when all that is there is read."""
    return edges.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def asserted_by_type(edges: DataFrame) -> DataFrame:
    """Running counts by tool and type of edges that assert a target (complete mode)."""
    loop = (F.col("fromId") == F.col("toId")) & F.col("resolved").eqNullSafe(False)
    return edges.groupBy("tool", "type").agg(F.count_if(~loop).alias("asserted"), F.count_if(loop).alias("abstentions"))
