"""A table function over rows of the log: callers name the columns they want, in a query or in SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import BooleanType, DataType, LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: What may be asked for: its type, and how it comes from a row and the number of rows of its folder so far.
FIELDS: dict[str, tuple[DataType, object]] = {
    "key": (LongType(), lambda r, n: r["hash"]),
    "uri": (StringType(), lambda r, n: r["video_uri"] or r["image_path"]),
    "is_video": (BooleanType(), lambda r, n: r["video_uri"] is not None),
    "seconds": (LongType(), lambda r, n: None if r["timestamp_ms"] is None else r["timestamp_ms"] // 1000),
    "number": (LongType(), lambda r, n: n),
}


@udtf
class LogFields:
    """log_fields(rows => TABLE(...), fields => 'key,uri,...'): folder_id and these FIELDS of rows of a log.

    Rows come by folder, in the order of hash and timestamp_ms; number counts them there from 1.  A field that isn't known is
    an error when the query is analysed.
    """

    def __init__(self) -> None:
        self.n, self.wanted = 0, None

    @staticmethod
    def analyze(rows: AnalyzeArgument, fields: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or not isinstance(fields.value, str):
            raise ValueError("log_fields takes a table and a text of fields")
        wanted = [f.strip() for f in fields.value.split(",")]
        if unknown := [f for f in wanted if f not in FIELDS]:
            raise ValueError(f"log_fields doesn't know {', '.join(unknown)}")
        schema = StructType().add("folder_id", StringType())
        for f in wanted:
            schema = schema.add(f, FIELDS[f][0])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("folder_id")], orderBy=[OrderingColumn("hash"), OrderingColumn("timestamp_ms")])

    def eval(self, rows: Row, fields: str) -> Iterator[tuple]:
        if self.wanted is None:
            self.wanted = [FIELDS[f.strip()][1] for f in fields.split(",")]
        self.n += 1
        yield (rows["folder_id"], *(f(rows, self.n) for f in self.wanted))


def register(spark: SparkSession) -> None:
    spark.udtf.register("log_fields", LogFields)
