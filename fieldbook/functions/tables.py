"""Table functions for SQL. Additions of this library; the surveyed product has none."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from fieldbook.session import ship


class _Sessions:
    """Rows (key, at) become sessions: a key's rows, each at most `gap` after the one before.

    Spark partitions the table by key and sorts it by time, as `analyze` asks; a task holds one session at a time, however many rows a key has. Nulls of
    `at` are skipped; null keys are a key. Columns: key (of the table's type), started, ended, n.
    """

    @staticmethod
    def analyze(table: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        fields = {f.name: f.dataType for f in table.dataType.fields} if table.isTable else {}
        if not {"key", "at"} <= set(fields) or not isinstance(fields["at"], (T.LongType, T.IntegerType)):
            raise ValueError("sessions takes a table with the columns key and at, at being a whole number")
        schema = T.StructType([T.StructField("key", fields["key"]), T.StructField("started", T.LongType()), T.StructField("ended", T.LongType()), T.StructField("n", T.LongType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("key")], orderBy=[OrderingColumn("at")])

    def __init__(self) -> None:
        self.open = None

    def eval(self, row, gap):
        if row["at"] is None:
            return
        if self.open and row["at"] - self.open[2] <= gap:
            self.open = (*self.open[:2], row["at"], self.open[3] + 1)
            return
        if self.open:
            yield self.open
        self.open = (row["key"], row["at"], row["at"], 1)

    def terminate(self):
        if self.open:
            yield self.open


def register_tables(spark: SparkSession) -> None:
    """Makes sessions(TABLE(t), gap) known to the session's SQL."""
    ship(spark)
    spark.udtf.register("sessions", udtf(_Sessions))
