"""One query for each operator of this subpackage, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.shipping import ship

#: The folder with the public tokenizers' vocabulary files.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> bytes:
    """A vocabulary file (under 2 MB), read on the driver."""
    with open(f"{TOKENIZERS}/{name}", "rb") as file:
        return file.read()


def op1_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.reshard import reshard_documents

    old = F.pmod(F.crc32(F.coalesce("source", F.lit("")).cast("binary")), F.lit(12))
    return reshard_documents(table(spark, sf_dir, "documents"), old, 16)


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.cross_polytope import nearest_neighbours

    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return nearest_neighbours(vectors, vectors.where("id % 100 = 0"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.ngram_join import ngram_jaccard_join

    joined = ngram_jaccard_join(table(spark, sf_dir, "documents"), k=4, num=85, den=100)
    return joined.select("doc_id", "n_shingles", "component_id")


def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.uniform_threshold import top_k, whole_numbers

    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), whole_numbers(F.col("embedding"), 1024).alias("v"))
    return top_k(vectors, vectors.where("id % 100 = 0"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.quality import quality_scores

    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    scored = quality_scores(table(spark, sf_dir, "documents"), labels)
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op6_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.piece_dropout import encode_documents

    docs = table(spark, sf_dir, "documents").withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    encoded = encode_documents(docs, vocabulary("piece_bpe_32k.model"), "doc_id", "text_crc32")
    return encoded.select("doc_id", F.size("pieces").alias("n_pieces"), "pieces", (F.col("text_crc32") == F.col("decoded_crc32")).alias("lossless"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), length=2048, pad=50256)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.source_mix import mix_sources, word_count

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("content"))
    mixed, _ = mix_sources(docs)
    return mixed.select("doc_id", "source", "size", "source_size", "target", "taken")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), "doc_id")


def op10_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.kneser_ney import language_model_scores

    return language_model_scores(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.conversation_trie import prefix_trie, rebuilt

    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.secret_scan import BASE, MORE, secret_spans

    found = secret_spans(table(spark, sf_dir, "documents"), (*BASE, *MORE), "doc_id")
    base = [r.kind for r in BASE]
    named = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = (F.size(of(k)).cast("long").alias(f"n_{k}") for k in base)
    return found.select("doc_id", *counts, F.sha2(named(of(*base)), 256).alias("base_sha256"), named(F.col("spans")).alias("spans"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from orrery.llm.conversation_repair import damaged, repair_conversations

    return repair_conversations(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {
    f.__name__: f
    for f in (op1_reshard, op2_nearest_neighbours, op3_ngram_jaccard, op4_top_k, op5_quality, op6_piece_dropout, op7_pack, op8_mix_sources, op9_token_counts, op10_language_model, op11_prefix_trie, op12_secrets, op13_repair)
}
#: CRC-32 of a short ASCII text for a second engine, from the table crc_table(t).
_CRC_TABLE = "crc_table AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)), i) AS c FROM range(256) AS r(i)))"


def _crc32(text: str) -> str:
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


def _either_case(*words: str) -> str:
    return "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word) for word in words)


#: Kind, regex, least length and the group that has it, of the rules of ``op12_secrets`` for a second engine.
_SECRETS = (
    ("assign", f"""({_either_case("password", "passwd", "secret", "token", "api_?key")})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 12, 2),
    ("access", "AKIA[A-Z0-9]+", 18, 0), ("hex", "[0-9a-f]{16,}", 16, 0), ("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----", 1, 0), ("host", "gh[opusr]_[A-Za-z0-9]+", 40, 0),
    ("chat", "xox[abeoprs]-[A-Za-z0-9-]+", 15, 0), ("claims", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, 0),
)
_SECRET_HITS = " UNION ALL ".join(
    f"""SELECT r, {i} AS i, '{kind}' AS kind, unnest(range(1, len(hits) + 1)) AS k, hits, string_split_regex(t, '{pattern}') AS parts, list_transform(hits, lambda h: len(regexp_extract(h, '{pattern}', {group})) >= {least}) AS fits
            FROM (SELECT r, t, regexp_extract_all(t, '{pattern}') AS hits FROM docs)"""
    for i, (kind, pattern, least, group) in enumerate(_SECRETS)
)

SQL: dict[str, str] = {
    "op3_ngram_jaccard": r"""
        WITH RECURSIVE docs AS (
            SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ), sets AS MATERIALIZED (
            SELECT r, doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + CASE WHEN len(w) > 0 THEN 1 ELSE 0 END), lambda i: array_to_string(w[i:i + 3], ' ')))) AS s FROM docs
        ), nodes AS MATERIALIZED (SELECT min(r) AS node, s FROM sets WHERE len(s) > 0 GROUP BY s), grams AS (SELECT node, len(s) AS n, unnest(s) AS g FROM nodes), often AS (
            SELECT g FROM grams GROUP BY g HAVING count(*) > 1
        ), met AS MATERIALIZED (SELECT node, n, g FROM grams SEMI JOIN often USING (g)), pairs AS (
            SELECT a.node AS a, b.node AS b, count(*) AS common, any_value(a.n) + any_value(b.n) AS n FROM met a JOIN met b ON a.g = b.g AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY 1, 2
        ), links AS (SELECT a, b FROM pairs WHERE 100 * common >= 85 * (n - common)), edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links), reach AS (
            SELECT node, node AS top FROM nodes UNION SELECT e.b, reach.top FROM reach JOIN edges e ON e.a = reach.node
        ), roots AS (SELECT node, min(top) AS root FROM reach GROUP BY node), members AS (
            SELECT sets.doc_id, len(sets.s) AS n, root FROM sets LEFT JOIN nodes USING (s) LEFT JOIN roots USING (node)
        )
        SELECT doc_id, n AS n_shingles, CASE WHEN root IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY root) END AS component_id FROM members
    """,
    "op8_mix_sources": r"""
        WITH docs AS (
            SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, ''))) AS h FROM documents
        ), sizes AS (
            SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM docs GROUP BY source
        ), caps AS (
            SELECT *, [5, 2, 1][place % 3 + 1]::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM sizes
        ), levels AS (
            SELECT *, greatest(sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0), 0) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level FROM caps
            WINDOW w AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), targets AS (
            SELECT *, floor(target + 0.5)::BIGINT AS words FROM (SELECT *, least(cap, max(level) OVER () * weight) AS target FROM levels)
        ), streams AS (
            SELECT doc_id, docs.source, size, source_size, target, words, sum(size) OVER (PARTITION BY place ORDER BY h, size ROWS UNBOUNDED PRECEDING) - size AS start
            FROM docs JOIN targets ON docs.source IS NOT DISTINCT FROM targets.source
        )
        SELECT doc_id, source, size, source_size, target, (greatest(least(start + size, words) - start, 0) + greatest(least(start + size + source_size, words) - start - source_size, 0))::BIGINT AS taken FROM streams
    """,
    "op4_top_k": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.v, r.v)::BIGINT AS score
            FROM whole q JOIN whole r ON q.vec_id <> r.vec_id WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
        )
        SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10
    """,
    "op12_secrets": f"""
        WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), hits AS ({_SECRET_HITS}), spans AS (
            SELECT r, i, kind, list_sum(list_transform(parts[1:k], lambda x: len(x))) + coalesce(list_sum(list_transform(hits[1:k - 1], lambda x: len(x))), 0) AS a, len(hits[k]) AS n FROM hits WHERE fits[k]
        ), named AS (SELECT r, i, kind, a, kind || ':' || a::BIGINT || ':' || (a + n)::BIGINT AS name FROM spans), found AS (
            SELECT r, count(*) FILTER (i = 0) AS n_assign, count(*) FILTER (i = 1) AS n_access, count(*) FILTER (i = 2) AS n_hex,
                string_agg(name, ',' ORDER BY a, i) FILTER (i < 3) AS base, string_agg(name, ',' ORDER BY a, i) AS spans FROM named GROUP BY r
        )
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN found USING (r)
    """,
    "op13_repair": rf"""
        WITH RECURSIVE {_CRC_TABLE}, raw AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k FROM conversations, crc_table
        ), ids AS (SELECT DISTINCT conv_id FROM raw), damaged AS (
            SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM (SELECT *, unnest(range(CASE k WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM raw)
        ), placed AS (
            SELECT *, left(role, 1) AS c, row_number() OVER w AS i, lag(left(role, 1)) OVER w AS before
            FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
        ), met AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM placed), faults AS MATERIALIZED (
            SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN again THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault FROM met
        ), ways(source, place, extra, letters, added) AS (
            VALUES (0, 0, 0, '', ''), (0, 2, 2, 'I', chr(10) || 'user:'), (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 1, 0, '', ''), (1, 2, 2, 'I', chr(10) || 'user:'),
                (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 0, '', ''), (2, 3, 2, 'I', chr(10) || 'assistant:'), (3, 3, 0, '', ''), (3, 2, 2, 'I', chr(10) || 'user:')
        ), moves(letter, place, c, goes, price) AS (
            VALUES ('D', 0, '', 0, 3), ('D', 1, '', 1, 3), ('D', 2, '', 2, 3), ('D', 3, '', 3, 3), ('R', 0, '', 2, 2), ('R', 1, '', 2, 2), ('R', 2, '', 3, 2), ('R', 3, '', 2, 2),
                ('K', 0, 's', 1, 0), ('K', 0, 'u', 2, 0), ('K', 1, 'u', 2, 0), ('K', 3, 'u', 2, 0), ('K', 2, 'a', 3, 0)
        ), walk AS (
            SELECT conv_id, 0::BIGINT AS i, 0 AS place, (0::BIGINT, '', '') AS best FROM ids
            UNION ALL
            SELECT w.conv_id, w.i + 1, m.goes, min((w.best[1] + y.extra + m.price + CASE WHEN f.fault = 't' AND m.letter <> 'D' THEN 1 ELSE 0 END, w.best[2] || y.letters || m.letter,
                w.best[3] || y.added || CASE m.letter WHEN 'D' THEN '' ELSE chr(10) || CASE WHEN m.letter = 'K' THEN f.role WHEN m.place = 2 THEN 'assistant' ELSE 'user' END || ':' || f.text END))
            FROM walk w JOIN faults f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN ways y ON y.source = w.place JOIN moves m ON m.place = y.place AND (m.letter <> 'K' OR m.c = f.c) AND (m.letter = 'D' OR f.fault IN ('', 't'))
            GROUP BY w.conv_id, w.i, m.goes
        ), tails(place, extra, letters, added) AS (VALUES (0, 0, '', ''), (3, 0, '', ''), (2, 2, 'I', chr(10) || 'assistant:'), (1, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')), counts AS (
            SELECT conv_id, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                count(*) FILTER (before IS NOT NULL AND before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id
        ), done AS (
            SELECT w.conv_id, min((w.best[1] + t.extra, w.best[2] || t.letters, w.best[3] || t.added)) AS best FROM walk w JOIN tails t USING (place) LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM w.conv_id WHERE w.i = coalesce(n.n, 0) GROUP BY w.conv_id
        )
        SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, d.best[1]::BIGINT AS cost, d.best[2] AS audit, sha256(d.best[3][2:]) AS repaired_sha256
        FROM done d LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM d.conv_id
    """,
    "op11_prefix_trie": f"""
        WITH {_CRC_TABLE}, ids AS (SELECT conv_id AS c, {_crc32("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), crc_table), turns AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS p FROM conversations
        ), built AS (
            SELECT c, p, role, text FROM ids JOIN turns ON conv_id = c AND p >= h UNION ALL SELECT c, p, role, text FROM ids JOIN turns ON conv_id = c - c % 100 AND p < h
        ), paths AS (
            SELECT c, row_number() OVER w AS depth, string_agg(md5(len(role) || ':' || role || text), '') OVER w AS path, len(text) AS chars FROM built WINDOW w AS (PARTITION BY c ORDER BY p)
            UNION ALL SELECT c, 0, '', 0 FROM ids
        ), ends AS (SELECT path, string_agg(c::VARCHAR, ',' ORDER BY c) AS ids FROM (SELECT c, arg_max(path, depth) AS path FROM paths GROUP BY c) GROUP BY path), nodes AS (
            SELECT path, any_value(depth) AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM paths GROUP BY path
        ), parents AS (SELECT path[1:-33] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1), known AS (
            SELECT n.*, coalesce(p.n, 0) AS n_children FROM nodes n LEFT JOIN parents p USING (path)
        ), sums AS (
            SELECT left(path, 32 * k::BIGINT) AS path, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS k FROM known) GROUP BY 1
        )
        SELECT k.conv_id, k.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, k.n_convs, k.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
        FROM known k JOIN sums s USING (path) LEFT JOIN ends e USING (path) LEFT JOIN nodes u ON k.depth > 0 AND u.path = k.path[1:-33]
    """,
}
