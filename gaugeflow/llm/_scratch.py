"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from gaugeflow.llm._carry import bounded


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where Spark runs in a single local process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not getattr(spark, "_gaugeflow_scratch", None):
        spark._gaugeflow_scratch = "file://" + tempfile.mkdtemp(prefix="gaugeflow-")
    return spark._gaugeflow_scratch


#: The owner of tables made from here on, if any.
_OWNER: contextvars.ContextVar[Owner | None] = contextvars.ContextVar("owner", default=None)


class Owner:
    """Owns the tables of all operator runs begun within its `with` block, and deletes them on release(), which is for callers
    that have written what they made of them. Tables of runs outside, and those of other owners, stay."""

    def __init__(self, spark: SparkSession):
        self.spark, self.roots = spark, []

    def __enter__(self) -> Owner:
        self._before = _OWNER.set(self)
        return self

    def __exit__(self, *_) -> None:
        _OWNER.reset(self._before)

    def release(self) -> None:
        while self.roots:
            _delete(self.spark, self.roots.pop())


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Written tables of one operator run, which the Owner around it can delete. A lost executor costs nothing but a re-read
    of the files."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = bounded(spark), f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        if owner := _OWNER.get():
            owner.roots.append(self.root)

    def table(self, df: DataFrame) -> DataFrame:
        """Writes df and returns the table as read back."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of which nothing later reads."""
        for df in tables:
            _delete(self.spark, df._scratch_path)
