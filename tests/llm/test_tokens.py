import base64
import gc
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import tiktoken
import xxhash
from helpers import AWKWARD, awkward, empty, words
from pyspark.sql import functions as F

from orrery.llm import packing as B
from orrery.llm import piece_dropout as P
from orrery.llm import token_counts as C
from orrery.llm.columns import content_key
from orrery.llm.queries import TOKENIZERS, vocabulary

TEXTS = [r[1] or "" for r in AWKWARD] + ["a\r\nb\t\n\nc  \n d ", "  lead", "it's 3,000 ½ “quoted”\n\n\n", "x" * 5000, "tab\t\n\nx \t y"]


def read(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)


def test_pieces_without_dropout_are_the_usual_ones(spark):
    model = vocabulary("piece_bpe_32k.model")
    sp, own = sentencepiece.SentencePieceProcessor(model_proto=model), P.Encoder(P.Vocabulary(model), 0.0, 1)
    for t in [*TEXTS, *(r.text for r in read(spark).collect())]:
        if "▁" not in t:
            assert own.encode(t, "").tolist() == sp.encode(t)


def test_encoding_leaves_no_lot_in_memory():
    """What a lot needs goes when it is done, and doesn't wait for a collection of cycles."""
    encoder = P.Encoder(P.Vocabulary(vocabulary("piece_bpe_32k.model")), 0.1, 1)
    held = lambda: sum(type(x) is defaultdict for x in gc.get_objects())
    gc.collect()
    gc.disable()
    try:
        before = held()
        for k in range(5):
            encoder.encode_texts([f"lot {k} of words", *TEXTS[-2:]], ["a", "b", "c"])
        assert held() == before
    finally:
        gc.enable()


def test_dropout_varies_and_decodes(spark):
    vocabulary_ = P.Vocabulary(model := vocabulary("piece_bpe_32k.model"))
    a, b, decoder = P.Encoder(vocabulary_, 0.1, 1), P.Encoder(vocabulary_, 0.1, 2), P.Decoder(vocabulary_)
    plain = P.Encoder(vocabulary_, 0.0, 1)
    for t in TEXTS:
        assert decoder.decode(a.encode(t, "7")) == t.encode() == decoder.decode(P.Encoder(vocabulary_, 0.9, 3).encode(t, "7"))
    docs = [r.text for r in read(spark).collect()]
    more = sum(len(a.encode(t, "7")) for t in docs) / sum(len(plain.encode(t, "7")) for t in docs)
    assert 1.02 < more < 1.5
    assert any(a.encode(t, "7").tolist() != b.encode(t, "7").tolist() for t in docs) and any(a.encode(t, "7").tolist() != a.encode(t, "8").tolist() for t in docs)
    df = awkward(spark)
    encoded = P.encode_documents(df, model, "doc_id", "text")
    rows = encoded.collect()
    assert len(rows) == len(AWKWARD) and [x.text or "" for x in P.decode_pieces(encoded, model, "doc_id").orderBy("doc_id").collect()] == [x.text or "" for x in encoded.orderBy("doc_id").collect()]
    assert all(len(r.pieces) == 0 for r in rows if not r.text)
    assert P.encode_documents(empty(spark), model, "doc_id").count() == 0


def plain_dropout(vocabulary_, text, key, rate, seed):
    """The same by looking through all pairs of one unit after another, with whole numbers of any size."""
    mask, out = 2**64 - 1, []

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    salt = xxhash.xxh64_intdigest(key, seed)
    for place, unit in enumerate(P._UNITS.findall(f" {text}") if text else ()):
        own, symbols, dropped, skips = mix(salt + place * 0x9E3779B97F4A7C15 & mask), list(unit), set(), 0

        def gap(k, own=own):
            u, n, limit = mix(own + (k + 1) * 0xD1342543DE82EF95 & mask), 0, 1.0 - rate
            while rate and limit * 2.0**64 >= 1 and u < int(limit * 2.0**64):
                n, limit = n + 1, limit * (1.0 - rate)
            return n if rate else -1

        left, ends = gap(0), list(range(1, len(unit) + 1))
        while True:
            # A skipped pair comes back only as another pair, when one of its sides has grown.
            found = [(vocabulary_.rank[a + b], i) for i, (a, b) in enumerate(itertools.pairwise(symbols)) if a + b in vocabulary_.rank and (ends[i] - len(a), ends[i], ends[i + 1]) not in dropped]
            if not found:
                break
            _, i = min(found)
            if left == 0:
                dropped.add((ends[i] - len(symbols[i]), ends[i], ends[i + 1]))
                skips += 1
                left = gap(skips)
                continue
            left -= 1
            symbols[i : i + 2] = [symbols[i] + symbols[i + 1]]
            del ends[i]
        out += [i for s in symbols for i in vocabulary_.pieces_of(s)]
    return out


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 0.9])
def test_dropout_is_that_of_one_unit_after_another(spark, rate):
    vocabulary_ = P.Vocabulary(vocabulary("piece_bpe_32k.model"))
    texts = [*(t[:200] for t in TEXTS), "Wörter, Straßen: naïve façade 東京 \U0001f600\U0001f600 " + "y" * 70, *(r.text[:2000] for r in read(spark).collect())]
    keys = [str(i) for i in range(len(texts))]
    pieces, ends = P.Encoder(vocabulary_, rate, 5).encode_texts(texts, keys)
    for text, key, ids in zip(texts, keys, np.split(pieces, ends[:-1]), strict=True):
        assert ids.tolist() == plain_dropout(vocabulary_, text, key, rate, 5)


def test_dropout_is_drawn_for_each_occurrence():
    vocabulary_ = P.Vocabulary(vocabulary("piece_bpe_32k.model"))
    encoder, decoder = P.Encoder(vocabulary_, 0.1, 1), P.Decoder(vocabulary_)
    ends = np.array([x.startswith(b" ") for x in vocabulary_.bytes])
    ids = encoder.encode(text := "international " * 4999 + "international", "7")
    words_ = [tuple(x) for x in np.split(ids, np.flatnonzero(ends[ids]))[1:]]
    assert len(set(words_)) > 20 and decoder.decode(ids) == text.encode()
    copies = [tuple(encoder.encode("the cat looked at the moon", str(i))) for i in range(3000)]
    assert len(set(copies)) > 100
    # Only one merge comes up, so the rate is seen as it is.
    ab = encoder.encode(" ".join(["a"] * 20_000), "8")
    assert abs(len(ab) / 20_000 - 1.1) < 0.01
    # What else is encoded at the same time doesn't change the result.
    pieces, bounds = encoder.encode_texts(["a b", text, "", "the cat looked at the moon"], ["1", "7", "3", "5"])
    assert pieces[bounds[0] : bounds[1]].tolist() == ids.tolist() and tuple(pieces[bounds[2] :]) == copies[5]


def greedy(word, entries, longest):
    n = at = 0
    while at < len(word):
        at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in entries)
        n += 1
    return n


def test_token_counts(spark):
    data = vocabulary("byte_bpe_50k.tiktoken")
    entries = set(C.read_ranks(data))
    longest = max(map(len, entries))
    df = read(spark).unionByName(awkward(spark).select("doc_id", "text", "lang", "source", "n_chars"))
    for r in C.token_counts(df, data, "doc_id", "text").collect():
        own = words(r.text)
        assert (r.n_words, r.n_tokens) == (len(own), sum(greedy(b" " + w, entries, longest) for w in own))
    assert C.token_counts(empty(spark), data, "doc_id").count() == 0


def test_automaton_on_small_vocabularies():
    r = random.Random(4)
    for _ in range(30):
        entries = {bytes([b]) for b in range(256)} | {bytes(r.choices(b"abc", k=r.randint(2, 7))) for _ in range(25)}
        a = C.Automaton(sorted(entries))
        for _ in range(50):
            w = bytes(r.choices(b"abc", k=r.randint(0, 20)))
            assert a.count(w) == greedy(w, entries, 7)
    with pytest.raises(ValueError, match="single bytes"):
        C.Automaton([b"a", b"ab"])


def test_ids_are_the_encoders(spark):
    data = vocabulary("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    whole, own = tiktoken.Encoding("x", pat_str=B.PATTERN, mergeable_ranks=ranks, special_tokens={}), B.encoder(data)
    for t in [*TEXTS, *(r.text for r in read(spark).collect())]:
        assert own(t).tolist() == whole.encode_ordinary(t)


def test_best_fit_decreasing():
    r = random.Random(6)
    for most in (7, 10, 64):
        lengths = [r.randint(1, most) for _ in range(200)]
        rows, room = B.best_fit_decreasing(lengths, most), []
        assert sorted(i for row in rows for i in row) == list(range(200))
        want: list[list[int]] = []
        for i in sorted(range(200), key=lambda i: (-lengths[i], i)):
            fits = [k for k, x in enumerate(room) if x >= lengths[i]]
            if fits:
                least = min(room[k] for k in fits)
                k = [k for k in fits if room[k] == least][-1]
            else:
                k = len(room)
                room.append(most)
                want.append([])
            want[k].append(i)
            room[k] -= lengths[i]
        assert sorted(sum(lengths[i] for i in row) for row in rows) == sorted(sum(lengths[i] for i in row) for row in want)
        assert all(sum(lengths[i] for i in row) <= most for row in rows)


def test_packed_documents_come_back(spark, tmp_path):
    data = vocabulary("byte_bpe_50k.tiktoken")
    df = read(spark).where("doc_id > 11").select("doc_id", "text").unionByName(awkward(spark).select("doc_id", "text"))
    df = df.unionByName(df.where("doc_id = 9").selectExpr("doc_id", "concat(text, ' more of the same ', text) as text"))
    packed = B.pack_documents(df, data, length=256, pad=50256)
    own, parts = B.encoder(data), {}
    for r in packed.collect():
        ids, positions = np.frombuffer(r.input_ids, np.int32), np.frombuffer(r.position_ids, np.int32)
        assert len(ids) == len(positions) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_ids <= 256 and (ids[r.n_ids :] == 50256).all()
        for d, key, p, a, b in zip(r.doc_ids, r.text_keys, r.pieces, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            assert positions[a:b].tolist() == list(range(b - a))
            parts.setdefault((d, key), {}).setdefault(p, []).append(ids[a:b].tolist())
    want = Counter()
    for r in df.withColumn("key", content_key(F.col("text"))).collect():
        if r.text:
            want[r.doc_id, r.key] += 1
            pieces = parts[r.doc_id, r.key]
            assert sum((pieces[p][0] for p in sorted(pieces)), []) == own(r.text).tolist()
    # Equal rows have each piece as often as there are such rows; the two long texts of one id are told apart.
    assert {k: {len(x) for x in p.values()} for k, p in parts.items()} == {k: {n} for k, n in want.items()}
    done = B.write_packs(packed, str(tmp_path / "packs")).collect()
    assert sum(r.n_rows for r in done) == packed.count()
    assert sum((tmp_path / "packs" / f"ids-{r.pack_group}").stat().st_size for r in done) == 1024 * packed.count()
    assert B.pack_documents(empty(spark), data).count() == 0
