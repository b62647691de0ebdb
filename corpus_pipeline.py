"""A corpus pipeline of four stages: quality filter, near-duplicate removal, source mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs.  All but the last return the columns of docs, whatever these are.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.columns import content_key, unused
from orrery.llm.cut import checkpoint_dir, cut
from orrery.llm.ngram_join import ngram_jaccard_join
from orrery.llm.piece_dropout import encode_documents
from orrery.llm.quality import fit, score
from orrery.llm.queries import table, vocabulary
from orrery.llm.source_mix import mix_sources, word_count


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more, learned from all labels whose documents are there."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    name = unused(docs.columns, "quality_score")
    scored = score(docs, fit(docs, labels), *docs.columns, name=name)
    return scored.where(F.col(name) >= 0.3).drop(name)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are alike by 0.8: that of the smallest doc_id.

    Documents are told apart by doc_id and text, so a null or repeated doc_id makes no difference (nulls come last, then
    the smaller hash of the text); of rows that have both in common one stays.  Documents without words are in no group.
    """
    own = content_key(F.col("text"))
    # Cut, so that the largest group is summed up where its rows are, and not in the one task that joins by root.
    joined = cut(ngram_jaccard_join(docs.select("doc_id", "text", own.alias("text_key")), "text_key", k=5, num=4, den=5))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    first = joined.where("root is not null").groupBy("root").agg(F.min(order).alias("first")).select("first.doc_id", "first.text_key")
    kept = first.union(joined.where("root is null").select("doc_id", "text_key").distinct())
    key, kept_id, kept_key = (unused(docs.columns, c) for c in ("key_of_text", "kept_id", "kept_key"))
    kept = kept.select(F.col("doc_id").alias(kept_id), F.col("text_key").alias(kept_key))
    rows = docs.withColumn(key, own)
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(key) == F.col(kept_key)), "left_semi")
    return rows.dropDuplicates(["doc_id", key]).drop(key)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: words taken over words, rounded to the nearest whole number.

    A document without words isn't taken.  Rows that have doc_id, source and text in common are each taken as often as the
    one that is taken most.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "source", word_count(F.col("text")).alias("size"), content_key(F.col("text")).alias("content"))
    mixed, _ = mix_sources(rows.select(F.struct(F.col("doc_id").cast("string").alias("doc_id"), F.col("content")).alias("doc_id"), "source", "size"))
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    mixed = mixed.where("size > 0").select(F.col("doc_id").alias("key"), F.col("source").alias("s"), times.alias("times"))
    mixed = mixed.groupBy("key", "s").agg(F.max("times").alias("times")).where("times > 0")
    mixed = mixed.select(F.col("key.doc_id").alias("id"), F.col("key.content").alias("c"), "s", "times")
    rows = rows.join(mixed, F.col("doc_id").cast("string").eqNullSafe(F.col("id")) & (F.col("content") == F.col("c")) & F.col("source").eqNullSafe(F.col("s")))
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the pieces of each document."""
    model = vocabulary("piece_bpe_32k.model")
    return encode_documents(docs, model, "doc_id", "lang", "source").select("doc_id", "lang", "source", F.size("pieces").alias("n_pieces"), "pieces")


STAGES = [("quality classifier", quality_filter), ("n-gram Jaccard join", near_duplicates), ("mixing sources", source_mix), ("SentencePiece encoding", encode)]

#: The classifier, the hashes of the join and the keyed dropout are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written under the checkpoint folder and read again; only the last one's files stay."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).delete(path(f"{folder}/{k - 1}"), True)
    return docs
