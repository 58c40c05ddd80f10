"""Session helpers: table access, the shared folder, lineage cuts."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table below ``sf_dir`` (any path Spark can read)."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def dealt(df: DataFrame, key: str) -> DataFrame:
    """``df`` dealt by ``key`` over all cores if its scan has fewer tasks than the session has cores.

    A small file is one row group, and what is computed from it would run on one
    core. Large tables have more tasks than cores and are left where they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, key) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in ``spark.checkpoint.dir``. Only where that is
    unset (a local session in a test) a temporary folder takes its place.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured.rstrip("/")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="strata-"))
    return context.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and forget how it was made.

    The copy outlives any executor, unlike a cached or locally checkpointed one.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def once(df: DataFrame) -> DataFrame:
    """:func:`cut`, and the shuffles that ``df``'s rows came through are dropped at once, not when garbage happens to be collected.

    For plans that nothing else reads; who does makes those shuffles again.
    """
    made, todo, seen = cut(df), [df._jdf.queryExecution().toRdd()], set()
    cleaner = df.sparkSession.sparkContext._jsc.sc().cleaner()
    while todo and cleaner.isDefined():
        rdd = todo.pop()
        if rdd.id() not in seen:
            seen.add(rdd.id())
            found = rdd.dependencies()
            for d in (found.apply(i) for i in range(found.size())):
                if d.getClass().getSimpleName() == "ShuffleDependency":
                    cleaner.get().doCleanupShuffle(d.shuffleId(), False)
                todo.append(d.rdd())
    return made


def small(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """``df``, cut and of a few numbers a row, marked for broadcast if it counts ``rows`` rows at most; else it is left to a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def only(df: DataFrame, ids: DataFrame, key: str = "pos") -> DataFrame:
    """The rows of ``df`` whose ``key`` is among ``ids``, one column; what ``df`` computes is computed for few others.

    A semi join stays above computed columns; a filter, here of :func:`marks`, goes below them.
    """
    ids = cut(ids.toDF(key).distinct())
    near = marks(ids.select(F.xxhash64(key).alias("h")), 24)
    return df.where(near(F.xxhash64(key))).join(small(ids), key, "left_semi")


def marks(hashes: DataFrame, bits: int = 26) -> Callable[[Column], Column]:
    """A test that holds for all of ``hashes``, one column of 64-bit values, and for few others; not for use inside lambdas.

    A map of ``2**bits`` bits, however many hashes there are, is made by the
    executors and goes to each task with the plan; so nothing is shuffled to look
    a value up. Whoever needs to be exact compares the values that pass.
    """
    words, chunk = bits - 6, 10
    word = lambda h: F.shiftrightunsigned(h, 64 - words)
    bit = lambda h: F.pmod(h, F.lit(64)).cast("int")
    h = F.col(hashes.columns[0])
    found = hashes.groupBy(word(h).alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(h))).alias("b"))
    zero = hashes.sparkSession.range(1 << words).select(F.col("id").alias("w"), F.lit(0).cast("bigint").alias("b"))
    whole = found.unionByName(zero).groupBy("w").agg(F.bit_or("b").alias("b"))
    parts = whole.groupBy(F.shiftrightunsigned("w", chunk).alias("part")).agg(F.sort_array(F.collect_list(F.struct("w", "b"))).alias("rows"))
    parts = parts.select("part", F.col("rows")["b"].alias("bits")).agg(F.sort_array(F.collect_list(F.struct("part", "bits"))).alias("rows"))
    at = cut(parts.select(F.flatten(F.col("rows")["bits"]).alias("bits"))).scalar()
    return lambda x: F.getbit(F.get(at, word(x).cast("int")), bit(x)) == 1


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: like :func:`cut`, and plans that read it twice can share an exchange."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def placed(spark: SparkSession, data: bytes, label: str) -> str:
    """A file of ``data`` in the shared folder, written through Hadoop's file system; its path ends with a fresh name."""
    jvm, path = spark.sparkContext._jvm, scratch_path(spark, label)
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(data)
    finally:
        out.close()
    return path
