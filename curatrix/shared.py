"""Tables in the shared folder, and joins that bear hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key with more than one row in HOT_SHARE of all rows is hot; so at most HOT_SHARE keys are.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all tasks share the driver's disk."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="curatrix-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def listed(spark: SparkSession, found) -> list[str]:
    """The paths of what a file system has listed."""
    return [p.toString() for p in spark._jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found) or []]


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage is cut, and a lost executor costs nothing.
    The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/curatrix/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """df for broadcast if it has at most so many rows, which is counted; else as it is, to be shuffled."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _ranged(df: DataFrame, order: list) -> tuple[DataFrame, Column, Column]:
    """df in a total order, sorted by ranges of equal counts in many tasks and materialised, with __place_id; the number of a
    row's range and its place there are parts of that."""
    number = F.monotonically_increasing_id()
    rows = materialise(df.orderBy(*order).withColumn("__place_id", number), "placed")
    return rows, F.shiftright("__place_id", 33), F.col("__place_id").bitwiseAND(F.lit((1 << 33) - 1))


def placed(df: DataFrame, order: list, name: str = "place") -> DataFrame:
    """df with each row's place in a total order, from 1, and materialised. A row's place is that in its range after the sizes of
    the ranges before, of which there is one a partition."""
    rows, part, at = _ranged(df, order)
    sizes = rows.groupBy(part.alias("__place_part")).agg(F.count("*").alias("__place_n"))
    before = sizes.select("__place_part", (F.sum("__place_n").over(Window.orderBy("__place_part")) - F.col("__place_n")).alias("__place_before"))
    return rows.join(F.broadcast(before), part == F.col("__place_part")).withColumn(name, (F.col("__place_before") + at + 1).cast("long")).drop("__place_id", "__place_part", "__place_before", "__place_n")


def running_sums(df: DataFrame, order: list, columns: list[str]) -> DataFrame:
    """df with running_{c} and total_{c} of each column c in a total order: sums within a range of equal counts after those of the
    ranges before, so values that lie close together do not meet in one task."""
    rows, part, _ = _ranged(df, order)
    rows = rows.withColumn("__place_part", part)
    sums = rows.groupBy("__place_part").agg(*[F.sum(c).alias(f"__{c}") for c in columns])
    up_to, whole = Window.orderBy("__place_part"), Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = sums.select("__place_part", *[(F.sum(f"__{c}").over(up_to) - F.col(f"__{c}")).alias(f"__before_{c}") for c in columns], *[F.sum(f"__{c}").over(whole).alias(f"total_{c}") for c in columns])
    inside = Window.partitionBy("__place_part").orderBy("__place_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.join(F.broadcast(before), "__place_part")  # a row for each partition of the sort
    return both.select(*df.columns, *[(F.col(f"__before_{c}") + F.sum(c).over(inside)).alias(f"running_{c}") for c in columns], *[f"total_{c}" for c in columns])


def by_position(df: DataFrame, name: str = "place") -> DataFrame:
    """Rows read from files, with their place in them: by path, then by the part of a file that a task reads, then as they come.
    df comes from files directly."""
    at = df.select("*", F.col("_metadata.file_path").alias("__path"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__row"))
    return placed(at, ["__path", "__start", "__row"], name).drop("__path", "__start", "__row")


def zipped(left: DataFrame, right: DataFrame, place: str = "place") -> DataFrame:
    """Rows of equal places side by side; an error unless both have as many. Both are materialised, as by_position gives them."""
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"{n} rows on the left and {m} on the right")
    return left.join(right, place)


def attach(left: DataFrame, right: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """left join of right, which has one row per key and, in size, the key's rows in left. Both are materialised.

    Keys with over 1/HOT_SHARE of left's rows number HOT_SHARE at most whatever the input, so these go by broadcast and
    left's hot rows stay where they are; all others are shuffled.
    """
    hot = right.filter(F.col(size) * HOT_SHARE > total)
    keys = F.broadcast(hot.select(key))
    few = left.join(F.broadcast(hot), key, "inner")
    rest = left.join(keys, key, "left_anti").join(right, key, "left")
    return few.unionByName(rest)
