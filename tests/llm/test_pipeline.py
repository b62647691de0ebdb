from collections import Counter

import corpus_pipeline as P
import pytest
from helpers import awkward, empty
from pyspark.sql import functions as F
from test_ngram_join import brute
from test_tokens import plain_dropout

from orrery.llm import quality as Q
from orrery.llm import source_mix as M
from orrery.llm.columns import content_key
from orrery.llm.piece_dropout import Vocabulary, decode_pieces
from orrery.llm.queries import vocabulary

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, FOLDER)
        out.write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < 3:
            assert docs.columns == columns
        rows = docs.collect()
        if k == 0:
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
            kept = {r.doc_id for r in rows}
            good = [d for d, q in labels.items() if q == 1]
            assert sum(d in kept for d in good) / len(good) >= 0.95 and sum(d in kept for d, q in labels.items() if q == 0) <= 3
        if k == 1:
            want = {c for _, _, c in brute([(r.doc_id, r.text) for r in before.collect()], 5, 4, 5)}
            assert sorted(r.doc_id for r in rows) == sorted(want)
        if k == 2:
            assert {r.doc_id for r in rows} <= {r.doc_id for r in before.collect()} and max(Counter(r.doc_id for r in rows).values()) <= 2
        if k == 3:
            texts = {r.doc_id: r.text for r in before.collect()}
            assert all(r.text == texts[r.doc_id] for r in decode_pieces(docs, vocabulary("piece_bpe_32k.model"), "doc_id").collect())
    assert P.run(spark, FOLDER).count() == docs.count()


def values(rows):
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("k", range(4))
def test_empty_table(spark, k):
    assert P.STAGES[k][1](spark, empty(spark), FOLDER).collect() == []


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    found = P.quality_filter(spark, docs, FOLDER)
    weights = Q.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", F.col("quality").alias("label")))
    scores = Q.score(docs.select("doc_id", "text"), weights, "doc_id", "text").collect()
    want = Counter((r.doc_id, r.text) for r in scores if r.quality_score >= 0.3)
    assert found.columns == docs.columns and Counter((r.doc_id, r.text) for r in found.collect()) == want and 0 < sum(want.values())


def test_duplicates_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = P.near_duplicates(spark, docs, FOLDER)
    assert rows.columns == docs.columns
    assert Counter(r.doc_id for r in rows.collect()) == {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 8: 1, 9: 2, 10: 1, None: 1, 11: 1}


def test_copies_of_null_and_repeated_ids_go(spark):
    text = "a passage of nine words that several documents share"
    rows = [(None, text)] * 3 + [(None, f"{text} here"), (None, "quite another text that nobody else has got")] + [(7, text), (7, "yet another text that stays with its id too"), (8, f"{text} here"), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # Five-word shingles: 5 of the passage, 6 with one more word; 5/6 is above 0.8.
    assert values(P.near_duplicates(spark, docs, FOLDER).collect()) == values([(7, text), (None, rows[4][1]), (7, rows[6][1]), (9, "")])
    alone = spark.createDataFrame([(None, text)] * 6, "doc_id long, text string")
    assert P.near_duplicates(spark, alone, FOLDER).count() == 1


def test_mix_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = docs.select("doc_id", "source", "text", M.word_count(F.col("text")).alias("size"), content_key(F.col("text")).alias("content"))
    mixed, _ = M.mix_sources(rows.select(F.struct(F.col("doc_id").cast("string").alias("doc_id"), F.col("content")).alias("doc_id"), "source", "size"))
    times = {}
    for r in mixed.where("size > 0").collect():
        key = (r.doc_id.doc_id, r.doc_id.content, r.source)
        times[key] = max(times.get(key, 0), int(r.taken / r["size"] + 0.5))
    want = Counter()
    for r in rows.collect():
        want[r.doc_id, r.text] += times.get((None if r.doc_id is None else str(r.doc_id), r.content, r.source), 0)
    found = P.source_mix(spark, docs, FOLDER)
    assert found.columns == docs.columns and Counter((r.doc_id, r.text) for r in found.collect()) == +want and not {3, 4, 5} & {d for d, _ in +want}


def test_encoding_of_awkward_rows(spark):
    docs = awkward(spark)
    vocabulary_ = Vocabulary(vocabulary("piece_bpe_32k.model"))
    short = docs.where("doc_id is null or doc_id <> 9")
    found = P.encode(spark, short, FOLDER).collect()
    want = [(r.doc_id, r.lang, r.source, plain_dropout(vocabulary_, r.text or "", str(r.doc_id), 0.1, 1)) for r in short.collect()]
    assert values((r.doc_id, r.lang, r.source, r.pieces) for r in found) == values(want) and all(r.n_pieces == len(r.pieces) for r in found)
