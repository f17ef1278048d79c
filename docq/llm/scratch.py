"""Tables that cut lineage, in the folder the cluster shares.

The folder is ``spark.checkpoint.dir``; only where that is unset and driver and
tasks are one process (tests) a local temporary folder takes its place.  A task that an executor loses is run
again from these files, never from memory of one machine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Rows up to which a side of short rows (ids, small arrays) may be broadcast.
BROADCAST_ROWS = 200_000
#: Bytes, written as JSON, up to which such a side may be broadcast where its rows hold texts or arrays.
BROADCAST_BYTES = 64 << 20


#: Keys that may be called hot: each holds more than one in so many of the rows.
HOT_KEYS = 50_000
HOT_ROWS = 1000


def skew_join(left: DataFrame, right: DataFrame, key: str, count: str, how: str = "inner", few: int | None = None, hot_keys: int = HOT_KEYS) -> DataFrame:
    """left joined (inner, left or left_semi) with right on a column; right, a written table,
    says in `count` about how many rows of left hold its key; count is not kept.

    Where right has at most `few` rows it is broadcast (by default, where it is small).  Else rows of left with a
    hot key, of more than HOT_ROWS rows and more than one in `hot_keys` of them
    all, are not shuffled: right's rows of these keys are broadcast, at most
    hot_keys where right has one row a key.  The rest is shuffled.
    """
    if small(right) if few is None else bounded_count(right, few):
        return left.join(F.broadcast(right.drop(count)), key, how)
    total = right.select(key, count).dropDuplicates([key]).agg(F.sum(count)).first()[0] or 0
    least = max(HOT_ROWS, total // hot_keys)
    hot, cold = right.where(F.col(count) > least).drop(count), right.where(F.col(count) <= least).drop(count)
    if hot.isEmpty():
        return left.join(right.drop(count), key, how)
    names = F.broadcast(hot.select(key).distinct())
    some = left.join(F.broadcast(hot) if bounded_count(hot, hot_keys) else hot, key, "left_semi" if how == "left_semi" else "inner")
    return some.unionByName(left.join(names, key, "left_anti").join(cold, key, how))


def bounded_count(df: DataFrame, most: int) -> bool:
    """Whether a written table has at most so many rows."""
    return df.limit(most + 1).count() <= most


def small(df: DataFrame) -> bool:
    """Whether a written table has at most BROADCAST_ROWS rows and, where they are of
    no fixed width, at most BROADCAST_BYTES bytes."""
    if not bounded_count(df, BROADCAST_ROWS):
        return False
    wide = [f.name for f in df.schema if isinstance(f.dataType, (StringType, BinaryType, ArrayType, MapType, StructType))]
    if not wide:
        return True
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in wide])))
    return (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES


def bounded(df: DataFrame) -> DataFrame:
    """df, a written table, for broadcast where its rows and bytes are counted and
    few; as it is beyond that, for Spark to shuffle."""
    return F.broadcast(df) if small(df) else df


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI; sets one of its own only where none is set and the
    master is local.  On a cluster an unset folder is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-docq-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """A folder of Parquet tables for one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/docq-{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0
        self.held: list[tuple[DataFrame, str]] = []

    def path(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it again."""
        path = self.path(name)
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables of this run that no later plan reads."""
        jvm = self.spark._jvm
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        for df, path in self.held:
            if any(df is t for t in tables):
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
        self.held = [(df, path) for df, path in self.held if not any(df is t for t in tables)]
