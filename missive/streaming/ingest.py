"""Extension: the archive kept from a stream of imports. The batch operators are missive.operators.archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from missive.operators.archive import upsert


def first_imports(stream: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    """The stream without rows whose key came before within ``late``; state older than that is dropped."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def keep_archive(stream: DataFrame, path: str, key: str, at: str, keep: dict[str, str | None], checkpoint: str) -> StreamingQuery:
    """Merges each batch into the archive as upsert() does; a batch that is run again changes nothing.

    Each state of the archive is a table of its own below ``path``, named by its batch; the batch before is its base.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        base = spark.read.parquet(f"{path}/{number - 1}") if number else None
        rows = batch if base is None else base.unionByName(batch)
        upsert(rows, key, at, keep).select(batch.columns).write.mode("overwrite").parquet(f"{path}/{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
