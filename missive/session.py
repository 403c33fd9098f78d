"""Session helpers: where lineage is cut and how tables are read."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# Shuffle files of a table that is written are not read again; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Methods of more bytes are never compiled by the JVM: such stages are better run as smaller ones.
LIMIT = "spark.sql.codegen.hugeMethodLimit"
WRITING = {CLEANUP: "true", LIMIT: "8000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Unset, a local master gets a temporary folder of its own; a cluster is refused, since no
    machine-local folder would do there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="missive-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Cut:
    """Lineage cuts: tables written to the shared folder and read back.

    ``keep`` writes a frame and returns it read from its files, so that a lost executor costs a read
    and not a recomputation. ``drop`` deletes a table that nothing reads any more. Parquet is used
    rather than ``checkpoint()`` for its column pruning and row counts.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/missive-{uuid.uuid4().hex}"
        self.made = 0
        atexit.register(self.close)

    def keep(self, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}"
        before = {k: self.spark.conf.get(k, None) for k in WRITING}
        try:
            for k, v in WRITING.items():
                self.spark.conf.set(k, v)
            df.write.parquet(path)
        finally:
            for k, v in before.items():
                self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._cut_path = path
        return back

    def drop(self, *frames: DataFrame | None) -> None:
        for df in frames:
            if df is not None and hasattr(df, "_cut_path"):
                self._delete(df._cut_path)

    def close(self) -> None:
        """Deletes all its tables; called when the driver ends, since results are read until then."""
        if self.root.startswith("file:"):
            shutil.rmtree(self.root.removeprefix("file:"), ignore_errors=True)
        elif self.made:
            with contextlib.suppress(Exception):  # the session may have ended before
                self._delete(self.root)

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
