"""Columns, types and plainly known values of every query of this subpackage, as it is registered."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from helpers import words

from orrery.llm import packing
from orrery.llm.queries import QUERIES, vocabulary

FOLDER = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_reshard": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op2_nearest_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op3_ngram_jaccard": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op4_top_k": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op5_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_piece_dropout": {"doc_id": "bigint", "pieces": "array<int>"},
    "op7_pack": {"input_ids": "binary", "position_ids": "binary", "cu_seqlens": "array<int>"},
    "op8_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op9_token_counts": {"doc_id": "bigint", "n_words": "bigint", "n_tokens": "bigint"},
    "op10_language_model": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op11_prefix_trie": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
    "op12_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op13_repair": {"conv_id": "bigint", "gaps": "bigint", "blank": "bigint", "duplicate": "bigint", "truncated": "bigint", "illegal": "bigint", "cost": "bigint", "audit": "string", "repaired_sha256": "string"},
}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


def fold(doc):
    return zlib.crc32(str(doc).encode()) % 5


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract(spark, texts, name):
    df = QUERIES[name](spark, FOLDER)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = df.collect()
    if "doc_id" in kinds and name != "op7_pack":
        assert sorted(r.doc_id for r in rows) == sorted(texts)
    if name == "op1_reshard":
        slots = defaultdict(list)
        for r in rows:
            assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id].encode()) + 1, zlib.crc32(texts[r.doc_id].encode()), "bytes", None)
            slots[r.shard].append(r.slot)
        assert set(slots) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    if name in ("op2_nearest_neighbours", "op4_top_k"):
        vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()}
        by = defaultdict(list)
        for r in rows:
            by[r.query_id].append(r)
        assert set(by) == {i for i in vectors if i % 100 == 0}
        whole = {i: np.floor(1024 * v).astype(int) for i, v in vectors.items()}
        hits = 0
        for q, found in by.items():
            found.sort(key=lambda r: r["rank"])
            others = [i for i in sorted(vectors) if i != q]
            if name == "op4_top_k":
                want = sorted(((int(whole[q] @ whole[i]), i) for i in others), key=lambda x: (-x[0], x[1]))[:10]
                assert [(r.score, r.vec_id) for r in found] == want
            else:
                want = sorted((float(np.sqrt(((vectors[q] - vectors[i]) ** 2).sum())), i) for i in others)[:10]
                assert all(abs(r.score - np.sqrt(((vectors[q] - vectors[r.vec_id]) ** 2).sum())) < 1e-12 for r in found)
                hits += len({i for _, i in want} & {r.vec_id for r in found})
            assert [r["rank"] for r in found] == list(range(1, 11))
        assert name == "op4_top_k" or hits >= 9 * len(by)
    if name == "op5_quality":
        labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
        assert all(r.held_out == (fold(r.doc_id) == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
        held = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
        assert sum(held) >= 0.9 * len(held)
    if name == "op6_piece_dropout":
        assert all(r.lossless and r.n_pieces == len(r.pieces) for r in rows)
    if name == "op8_mix_sources":
        assert all(r["size"] == len(words(texts[r.doc_id])) and 0 <= r.taken <= 2 * r["size"] for r in rows)
    if name == "op9_token_counts":
        assert all(r.n_words == len(words(texts[r.doc_id])) <= r.n_tokens for r in rows)
    if name == "op10_language_model":
        assert all(r.held_out == (fold(r.doc_id) == 1) and r.n_tokens == len(words(texts[r.doc_id])) + 1 for r in rows)
        assert {r.train_tokens for r in rows} == {sum(r.n_tokens for r in rows if not r.held_out)}


def test_packs_are_written_and_read(spark, texts, tmp_path):
    packed = QUERIES["op7_pack"](spark, FOLDER).cache()
    done = packing.write_packs(packed, str(tmp_path / "packs")).collect()
    assert sum(r.n_rows for r in done) == packed.count()
    read = lambda name, group: np.fromfile(tmp_path / "packs" / f"{name}-{group}", np.int32)
    own, pieces = packing.encoder(vocabulary("byte_bpe_50k.tiktoken")), defaultdict(dict)
    for r in done:
        group = r.pack_group
        ids, positions, lengths = read("ids", group).reshape(-1, 2048), read("positions", group).reshape(-1, 2048), read("lengths", group)
        bounds = np.split(lengths, np.flatnonzero(lengths == 0)[1:])
        rows = packed.where(f"pack_group = {group}").orderBy("pack_row").collect()
        for row, x, p, ends in zip(rows, ids, positions, bounds, strict=True):
            for doc, piece, a, b in zip(row.doc_ids, row.pieces, ends[:-1], ends[1:], strict=True):
                assert p[a:b].tolist() == list(range(b - a))
                pieces[doc][piece] = x[a:b].tolist()
    assert {d: sum((p[k] for k in sorted(p)), []) for d, p in pieces.items()} == {d: own(t).tolist() for d, t in texts.items() if t}
