"""Domain views over the star-schema tables: a media library with people, faces and dates.

Face ids are made from their keys, never by numbering all rows, so every view is one scan with at most one
aggregation by its own key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Library:
    """Lazily built views of one folder of tables."""

    spark: SparkSession
    sf_dir: str

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def index(self) -> DataFrame:
        """Vector index: ord, embedding, folder_id, is_video, media_key, timestamp_ms; every fourth triple is one video."""
        video = F.floor(F.col("vec_id") / 3) % 4 == 0
        return self.table("embeddings").select(
            F.col("vec_id").alias("ord"), "embedding", F.col("label").alias("folder_id"), video.alias("is_video"),
            F.when(video, F.col("vec_id") - F.col("vec_id") % 3).otherwise(F.col("vec_id")).alias("media_key"),
            F.when(video, (F.col("vec_id") % 3) * 1000).otherwise(0).alias("timestamp_ms"),
        )

    def people(self) -> DataFrame:
        key = F.col("s_suppkey")
        return self.table("supplier").select(key.alias("id"), F.when(key % 4 != 0, F.col("s_name")).alias("name"), (F.col("s_acctbal") < 0).alias("hidden"), (key % 10 == 1).alias("pinned"))

    def faces(self) -> DataFrame:
        """One face for each (media, place in it)."""
        rows = self.table("lineitem").groupBy("l_orderkey", "l_linenumber")
        rows = rows.agg(F.min("l_suppkey").alias("person"), F.max("l_quantity").alias("rank"), F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"), F.max("l_discount").alias("box_r"), F.max("l_tax").alias("tax"))
        place = F.col("l_linenumber")
        return rows.select(
            (F.col("l_orderkey") * 10 + place).alias("id"), F.col("l_orderkey").alias("media_key"), F.when(place != 7, F.col("person")).alias("person_id"), "rank",
            (F.col("flag") != "R").alias("good"), ((place == 1) & (F.col("status") == "O")).alias("locked"), F.lit(0.0).alias("box_l"), "box_r", F.lit(0.0).alias("box_t"),
            (F.col("tax") / 2).alias("box_b"), (place == 6).alias("deferred"),
        )

    def photos(self) -> DataFrame:
        key = F.col("o_orderkey")
        return self.table("orders").select(key.alias("hash"), F.concat(F.lit("uri"), key).alias("uri"), (key % 10 == 0).alias("is_video"), ((key % 5) * 1000).alias("ts_ms"))

    def media_dates(self) -> DataFrame:
        key, taken = F.col("o_orderkey"), F.unix_millis(F.col("o_orderdate").cast("timestamp"))
        return self.table("orders").select(key.alias("key"), taken.alias("taken_ms"), (key % 6).cast("int").alias("src"), (key % 17 == 0).alias("junk"))

    def file_names(self) -> DataFrame:
        key = F.col("o_orderkey")
        plain = F.concat(F.lit("IMG_"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("_"), key, F.lit(".jpg"))
        return self.table("orders").select(key.alias("key"), F.when(key % 7 == 0, F.concat(F.lit("photo_"), key, F.lit(".jpg"))).otherwise(plain).alias("name"))

    def sightings(self) -> DataFrame:
        """Events as (person, ts_ms, kind, value)."""
        return self.table("events").select("event_id", F.col("user_id").alias("person"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_type").alias("kind"), "value")


#: The same views for DuckDB, to be put before an oracle query.
SQL_VIEWS = """
WITH RECURSIVE idx AS (
  SELECT vec_id AS ord, embedding, label AS folder_id, (vec_id // 3) % 4 = 0 AS is_video,
    CASE WHEN (vec_id // 3) % 4 = 0 THEN vec_id - vec_id % 3 ELSE vec_id END AS media_key,
    CASE WHEN (vec_id // 3) % 4 = 0 THEN (vec_id % 3) * 1000 ELSE 0 END AS timestamp_ms FROM embeddings
), people AS (
  SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 0 THEN s_name END AS name, s_acctbal < 0 AS hidden, s_suppkey % 10 = 1 AS pinned FROM supplier
), faces AS (
  SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS media_key, CASE WHEN l_linenumber <> 7 THEN min(l_suppkey) END AS person_id,
    max(l_quantity) AS rank, max(l_returnflag) <> 'R' AS good, l_linenumber = 1 AND max(l_linestatus) = 'O' AS locked,
    0.0::DOUBLE AS box_l, max(l_discount) AS box_r, 0.0::DOUBLE AS box_t, max(l_tax) / 2 AS box_b, l_linenumber = 6 AS deferred
  FROM lineitem GROUP BY l_orderkey, l_linenumber
), photos AS (
  SELECT o_orderkey AS hash, 'uri' || o_orderkey AS uri, o_orderkey % 10 = 0 AS is_video, (o_orderkey % 5) * 1000 AS ts_ms FROM orders
), media_dates AS (
  SELECT o_orderkey AS key, epoch_us(o_orderdate::TIMESTAMP) // 1000 AS taken_ms, (o_orderkey % 6)::INTEGER AS src, o_orderkey % 17 = 0 AS junk FROM orders
), file_names AS (
  SELECT o_orderkey AS key, CASE WHEN o_orderkey % 7 = 0 THEN 'photo_' || o_orderkey || '.jpg'
    ELSE 'IMG_' || strftime(o_orderdate, '%Y%m%d') || '_' || o_orderkey || '.jpg' END AS name FROM orders
), sightings AS (
  SELECT event_id, user_id AS person, epoch_us(ts::TIMESTAMP) // 1000 AS ts_ms, event_type AS kind, value FROM events
), confident AS (
  SELECT * FROM faces WHERE locked OR (good AND (box_r - box_l >= 0.04 OR box_b - box_t >= 0.04))
), listed AS (
  SELECT p.* FROM people p WHERE NOT hidden AND id IN (SELECT person_id FROM faces GROUP BY person_id HAVING count(DISTINCT media_key) >= 2)
), reliable AS (
  SELECT * FROM media_dates WHERE src IN (1, 2, 3) AND NOT junk
)"""
