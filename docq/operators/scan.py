"""Prefix scans: ordered windows over keys that may hold any share of the rows.

A key of more rows than a chunk is cut into chunks along its order.  Borders
are every so-manieth of a hashed sample of the order's values, so they do not
hang on partitions or settings.  Windows then run inside (key, chunk); what the chunks
before a chunk leave behind is one small value a chunk, carried along
the key and joined back.  Rows move once, on (key, chunk).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Chunks of all keys together, about; what is broadcast has so many rows or a small multiple.
CHUNKS = 4096
#: Sampled values for each border.
SAMPLES = 32
#: Borders that are looked through at once: every so-manieth first, then those between two of them.
STEP = 64


@dataclass
class Chunked:
    """rows with chunk_ (from 0 along the order of a key) and hot_ (of a key with several chunks)."""

    rows: DataFrame
    key: str
    order: list[str]
    any_hot: bool

    def window(self, descending: bool = False) -> WindowSpec:
        return Window.partitionBy(self.key, "chunk_").orderBy(*[F.desc(c) if descending else F.asc(c) for c in self.order])

    def hot(self) -> DataFrame:
        return self.rows.where("hot_")

    def with_before(self, df: DataFrame, chunks: DataFrame, first: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
        """df with before_: what `step` makes of `first` and the v_ of the chunks before a row's own.
        chunks: key, chunk_, v_ for every chunk of every hot key.  Null for other keys."""
        kind = dict(chunks.dtypes)["v_"]
        c = F.sort_array(F.collect_list(F.struct("chunk_", "v_")))
        start = F.struct(first.cast(kind).alias("now"), F.expr(f"cast(array() as array<struct<chunk_:int,before_:{kind}>>)").alias("out"))

        def fold(acc: Column, x: Column) -> Column:
            one = F.struct(x["chunk_"].alias("chunk_"), acc["now"].alias("before_"))
            return F.struct(step(acc["now"], x["v_"]).cast(kind).alias("now"), F.array_append(acc["out"], one).alias("out"))

        out = F.aggregate(c, start, fold, lambda acc: acc["out"])
        before = chunks.groupBy(F.col(self.key).alias("k_")).agg(out.alias("c")).select("k_", F.inline("c")).withColumnRenamed("chunk_", "c_")
        # One row a chunk, of about CHUNKS.
        return df.join(F.broadcast(before), F.col(self.key).eqNullSafe(F.col("k_")) & (F.col("chunk_") == F.col("c_")), "left").drop("k_", "c_")


def chunked(df: DataFrame, key: str, order: list[str], chunk_rows: int = 100_000) -> Chunked:
    """df in chunks of about chunk_rows rows (more where they would be more than CHUNKS).

    Counts rows by key at once.  The order should be total: rows that
    agree in all of it are in one chunk.  Nulls come first; null keys are one key.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("n_"))
    total, most = sizes.agg(F.coalesce(F.sum("n_"), F.lit(0)), F.coalesce(F.max("n_"), F.lit(0))).first()
    size = max(chunk_rows, -(-total // CHUNKS))
    if most <= size:
        return Chunked(df.withColumn("chunk_", F.lit(0)).withColumn("hot_", F.lit(False)), key, order, False)
    # Fewer keys than CHUNKS hold more rows than a chunk each.
    hot = F.broadcast(sizes.where(F.col("n_") > size).select(F.col(key).alias("k_")))
    picked = F.pmod(F.xxhash64(*order), F.lit(1 << 30)) < int(min(1.0, SAMPLES / size) * (1 << 30))
    sample = df.where(picked).select(F.col(key).alias("g_"), F.struct(*order).alias("x_")).join(hot, F.col("g_").eqNullSafe(F.col("k_")), "left_semi")
    sample = sample.groupBy(F.col("g_").alias("k_")).agg(F.sort_array(F.collect_set("x_")).alias("s"))
    borders = sample.select(
        "k_", F.filter("s", lambda x, i: i % SAMPLES == SAMPLES - 1).alias("fine_"), F.filter("s", lambda x, i: i % (SAMPLES * STEP) == SAMPLES * STEP - 1).alias("coarse_")
    )
    x = F.struct(*order)
    skip = F.size(F.filter("coarse_", lambda b: b <= x)) * STEP
    place = skip + F.size(F.filter(F.slice("fine_", skip + 1, F.lit(STEP)), lambda b: b <= x))
    rows = df.join(F.broadcast(borders), F.col(key).eqNullSafe(F.col("k_")), "left")
    rows = rows.withColumn("hot_", F.col("fine_").isNotNull()).withColumn("chunk_", F.when(F.col("hot_"), place).otherwise(0)).drop("k_", "fine_", "coarse_")
    return Chunked(rows, key, order, True)


def row_index(df: DataFrame, key: str, order: list[str], chunk_rows: int = 100_000) -> DataFrame:
    """df with i_ (from 0, along the key's order) and n_ (rows of the key)."""
    c = chunked(df, key, order, chunk_rows)
    w = Window.partitionBy(key, "chunk_")
    out = c.rows.withColumn("i_", F.row_number().over(c.window()).cast("long") - 1).withColumn("n_", F.count("*").over(w))
    if c.any_hot:
        sizes = c.hot().groupBy(key, "chunk_").agg(F.count("*").alias("v_"))
        totals = F.broadcast(sizes.groupBy(F.col(key).alias("k_")).agg(F.sum("v_").alias("total_")))
        out = c.with_before(out, sizes, F.lit(0), lambda now, v: now + v).join(totals, F.col(key).eqNullSafe(F.col("k_")), "left").drop("k_")
        out = out.withColumn("i_", F.col("i_") + F.coalesce("before_", F.lit(0))).withColumn("n_", F.coalesce("total_", "n_")).drop("before_", "total_")
    return out.drop("chunk_", "hot_")


def running_total(df: DataFrame, key: str, order: list[str], value: str, chunk_rows: int = 100_000) -> DataFrame:
    """running: sum of a value over the rows of its key up to each row; null until one is not null."""
    c = chunked(df, key, order, chunk_rows)
    out = c.rows.withColumn("running", F.sum(value).over(c.window().rowsBetween(Window.unboundedPreceding, 0)))
    if c.any_hot:
        sums = c.hot().groupBy(key, "chunk_").agg(F.sum(value).alias("v_"))
        out = c.with_before(out, sums, F.lit(None), lambda now, v: F.coalesce(now + v, now, v))
        out = out.withColumn("running", F.coalesce(F.col("running") + F.col("before_"), "running", "before_")).drop("before_")
    return out.drop("chunk_", "hot_")


def moving_average(df: DataFrame, key: str, order: list[str], value: str, k: int, chunk_rows: int = 100_000) -> DataFrame:
    """moving: mean of a value and of up to k before it, nulls left out.  The k values before
    a chunk go with it, so k is small against a chunk."""
    c = chunked(df, key, order, max(chunk_rows, k))
    w, v = c.window().rowsBetween(-k, 0), F.col(value).cast("double")
    if not c.any_hot:
        return c.rows.withColumn("moving", F.avg(v).over(w)).drop("chunk_", "hot_")
    last = c.hot().withColumn("r_", F.row_number().over(c.window(descending=True))).where(F.col("r_") <= k)
    tails = last.groupBy(key, "chunk_").agg(F.sort_array(F.collect_list(F.struct((-F.col("r_")).alias("r"), v.alias("v")))).alias("t"))
    tails = tails.select(key, "chunk_", F.col("t.v").alias("v_"))

    def step(now: Column, tail: Column) -> Column:
        both = F.concat(now, tail)
        return F.slice(both, F.greatest(F.size(both) - k + 1, F.lit(1)), F.lit(k))

    out = c.rows.withColumn("s_", F.sum(v).over(w)).withColumn("n_", F.count(v).over(w)).withColumn("r_", F.row_number().over(c.window()))
    out = c.with_before(out, tails, F.array(), step)
    # A row of place r in its chunk wants k - r + 1 values more.
    more = F.greatest(k + 1 - F.col("r_"), F.lit(0))
    halo = F.filter(F.slice("before_", F.greatest(F.size("before_") - more + 1, F.lit(1)), more), lambda x: x.isNotNull())
    halo = F.coalesce(F.when(more > 0, halo), F.array().cast("array<double>"))
    total = F.coalesce("s_", F.lit(0.0)) + F.aggregate(halo, F.lit(0.0), lambda a, x: a + x)
    n = F.col("n_") + F.size(halo)
    return out.withColumn("moving", F.when(n > 0, total / n)).drop("chunk_", "hot_", "s_", "n_", "r_", "before_")


def forward_fill(df: DataFrame, key: str, order: list[str], col: str, chunk_rows: int = 100_000) -> DataFrame:
    """{col}_filled: the last value of a column that is not null, at or before each row."""
    c = chunked(df, key, order, chunk_rows)
    out = c.rows.withColumn(f"{col}_filled", F.last(col, ignorenulls=True).over(c.window().rowsBetween(Window.unboundedPreceding, 0)))
    if c.any_hot:
        last = c.hot().groupBy(key, "chunk_").agg(F.max_by(col, F.when(F.col(col).isNotNull(), F.struct(*order))).alias("v_"))
        out = c.with_before(out, last, F.lit(None), lambda now, v: F.coalesce(v, now))
        out = out.withColumn(f"{col}_filled", F.coalesce(f"{col}_filled", "before_")).drop("before_")
    return out.drop("chunk_", "hot_")


def quantile_pick(df: DataFrame, key: str, order: list[str], n: int, chunk_rows: int = 100_000) -> DataFrame:
    """Rows at index size * i // (n + 1), i = 1..n, of each key's order."""
    at = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long")), lambda i: F.floor(F.col("n_") * i / (n + 1)))
    return row_index(df, key, order, chunk_rows).where(F.array_contains(at, F.col("i_"))).drop("i_", "n_")
