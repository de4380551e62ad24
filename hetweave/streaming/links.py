"""Link weights kept up to date from a stream of raw links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_links(raw: DataFrame) -> DataFrame:
    """(ltype, src, dst, w) summed over all links (ltype, src, dst, w) that a stream has brought.

    State is one sum for each distinct link. Links have no event time, so nothing expires.
    """
    return raw.groupBy("ltype", "src", "dst").agg(F.sum(F.coalesce("w", F.lit(1.0))).alias("w"))


def keep_link_table(raw: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each batch's sums to a parquet table, one folder a batch, until the source is read out.

    The sums of a batch are written under its number, so a batch that runs again after a failure
    overwrites its own rows and counts once. link_table() adds the batches up.
    """

    def write(batch: DataFrame, number: int) -> None:
        running_links(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def link_table(spark, path: str) -> DataFrame:
    """The link table of keep_link_table() as of now."""
    return running_links(spark.read.option("basePath", path).parquet(f"{path}/batch=*").select("ltype", "src", "dst", "w"))
