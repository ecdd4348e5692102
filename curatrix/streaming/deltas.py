"""A keyed table that a stream keeps up to date: each micro-batch writes the rows that have changed, and nothing else.

Every so many deltas become a base of each key's latest row, and what is older is deleted, so files grow with the keys. A
micro-batch that is repeated after a failure writes its delta again. A folder counts once it is written to its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Deltas that become a base.
COMPACT = 16


def write_delta(batch: DataFrame, epoch: int, path: str, keys: list[str], compact: int = COMPACT) -> None:
    """A micro-batch's changed rows, one a key; without keys the table is one row."""
    spark, root = batch.sparkSession, path.rstrip("/")
    batch.write.mode("overwrite").parquet(f"{root}/delta/epoch={epoch:012d}")
    if epoch % compact == compact - 1:
        read_latest(spark, root, batch.schema, keys, epoch).write.mode("overwrite").parquet(f"{root}/base/epoch={epoch:012d}")
        for kind, last in (("delta", epoch), ("base", epoch - 1)):
            for e, p in _epochs(spark, f"{root}/{kind}"):
                if e <= last:
                    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _epochs(spark: SparkSession, path: str) -> list[tuple]:
    """The epochs that were written to their end, with their folders."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch=*/_SUCCESS")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p) or []
    return sorted(((int(s.getPath().getParent().getName().split("=")[1]), s.getPath().getParent()) for s in found), key=lambda x: x[0])


def read_latest(spark: SparkSession, path: str, schema, keys: list[str], until: int | None = None) -> DataFrame:
    """The latest row of each key: that of the newest base, or of a delta after it."""
    root = path.rstrip("/")
    bases = [e for e, _ in _epochs(spark, f"{root}/base") if until is None or e < until]
    deltas = [e for e, _ in _epochs(spark, f"{root}/delta") if (until is None or e <= until) and (not bases or e > bases[-1])]
    rows = None
    for kind, e in [("base", e) for e in bases[-1:]] + [("delta", e) for e in deltas]:
        one = spark.read.schema(schema).parquet(f"{root}/{kind}/epoch={e:012d}").withColumn("__epoch", F.lit(e))
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        return spark.createDataFrame([], schema)
    columns = [c for c in rows.columns if c not in (*keys, "__epoch")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), "__epoch").alias("__row"))
    return latest.select(*keys, "__row.*").select(*[c for c in rows.columns if c != "__epoch"])
