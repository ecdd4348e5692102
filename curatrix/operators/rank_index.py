"""An order that is stored: ranges of a queue as folders, and their sizes, so that an item or a page is a read of one or two.

Sorting happens once, when the index is written, by ranges in many tasks. The sizes are a row for each range.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from curatrix.shared import materialise

#: Rows of a range.
TOGETHER = 100_000


@dataclass(frozen=True)
class RankIndex:
    spark: SparkSession
    path: str
    schema: StructType

    @staticmethod
    def write(rows: DataFrame, order: list, path: str, together: int = TOGETHER) -> RankIndex:
        """Store rows in a total order: each task of the sort writes its range of about so many rows, with their places in it."""
        number, rows = F.monotonically_increasing_id(), materialise(rows, "ranked")
        ranges = max(1, -(-rows.count() // together))
        ranged = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("*", number.bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"), F.shiftright(number, 33).alias("range"))
        ranged.write.mode("errorifexists").partitionBy("range").parquet(f"{path}/rows")
        index = RankIndex(rows.sparkSession, path, StructType.fromJson(rows.schema.jsonValue()))
        sizes = index._ranges().groupBy("range").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.orderBy("range")) - F.col("n")
        sizes.select("range", "n", before.alias("before")).coalesce(1).write.mode("errorifexists").parquet(f"{path}/sizes")
        return index

    def _ranges(self) -> DataFrame:
        full = StructType.fromJson(self.schema.jsonValue()).add("__at", "long").add("range", "integer")
        if not self._has_rows():
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(f"{self.path}/rows")

    def _has_rows(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/range=*")
        return bool(p.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(p))

    def sizes(self) -> DataFrame:
        return self.spark.read.schema("range int, n long, before long").parquet(f"{self.path}/sizes")

    def total(self) -> int:
        return self.sizes().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def page(self, offset: int, limit: int) -> DataFrame:
        """limit rows from offset on, which is moved to the last row if it is past it, with their position from 0. Only ranges
        that hold them are listed and read."""
        total = self.total()
        first = max(0, min(offset, total - 1))
        some = self.sizes().filter((F.col("before") < first + limit) & (F.col("before") + F.col("n") > first)).collect()  # the ranges of a page
        rows = self._ranges().filter(F.col("range").isin([r["range"] for r in some])) if some else self._ranges().limit(0)
        before = F.coalesce(*[F.when(F.col("range") == r["range"], F.lit(r["before"])) for r in some]) if some else F.lit(0)
        position = (before + F.col("__at")).cast("long")
        return rows.withColumn("position", position).filter(F.col("position").between(first, first + limit - 1)).drop("__at", "range")

    def item(self, index: int) -> DataFrame:
        """The row at index, or the first or last one, with its position and the total; nothing if there is none."""
        return self.page(max(0, index), 1).withColumn("total", F.lit(self.total()).cast("long"))
