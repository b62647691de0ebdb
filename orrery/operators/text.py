"""Query texts: words worth explaining, people named in them, and token ids for a text encoder."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words that say nothing about a picture.
STOP_WORDS = (
    "a", "an", "the", "of", "in", "on", "at", "to", "for", "with", "and", "or", "is", "are", "was", "were", "be",
    "been", "my", "me", "i", "this", "that", "these", "those", "some", "near", "by", "from", "it", "its", "as",
    "into", "photo", "photos", "picture", "pictures", "image", "images", "video", "videos",
)
#: What is dropped when it is all that stands between two names.
CONNECTORS = ("and", "&", "with", ",")


def content_words(text: Column) -> Column:
    """Distinct words of three letters or digits and more, in order, without stop words."""
    words = F.split(F.lower(text), "[^a-z0-9]+")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS)))


def mentions(texts: DataFrame, people: DataFrame) -> DataFrame:
    """id, person, at: people of people (id, name) named in texts (id, text) as whole words, whatever the case.

    A name that several people have says nothing, and is left out.  at: place of the first match, from 0.  Candidates
    meet on the first word of a name, so texts and people are joined by key; what is dealt out for that is a text's id and
    words, and the text itself once.
    """
    named = people.where("trim(name) <> ''")
    alone = named.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("name"))).where("n = 1").select(F.col("id").alias("person"), "name")
    alone = alone.withColumn("word", F.regexp_extract(F.lower("name"), "[a-z0-9_]+", 0))
    words = texts.select("id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0)))).alias("word"))
    pattern = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])\Q"), F.col("name"), F.lit(r"\E(?![A-Za-z0-9_])"))
    # Once for each id, with its people in one row, so that a text isn't copied for them.
    asked = words.join(alone, "word").groupBy(F.col("id").alias("of")).agg(F.collect_set(F.struct("person", "name")).alias("asked"))
    found = texts.select("id", "text").join(asked, F.col("id").eqNullSafe(F.col("of"))).select("id", "text", F.inline("asked"))
    found = found.withColumn("at", F.regexp_instr("text", pattern) - 1).where("at >= 0")
    return found.select("id", "person", "name", "at").distinct()


def query_without_mentions(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the spans (and an @ before one), bare connectors between them, and doubled spaces."""
    gaps, at = [], 0
    for start, end in sorted(spans):
        if end > len(text) or start < at:
            continue
        gaps.append(text[at : start - (start > at and text[start - 1] == "@")])
        at = end
    gaps.append(text[at:])
    return " ".join(" ".join("" if spans and g.strip().lower() in CONNECTORS else g for g in gaps).split())


#: The words of a text for the encoder's vocabulary, and what marks a word's end in it.
TOKEN_WORDS, WORD_END = r"(?U)'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+", "</w>"


def byte_signs() -> list[str]:
    """A visible sign for each byte: itself where it is one in Latin-1, the others by order from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b if b in shown else 256 + hidden.index(b)) for b in range(256)]


class WordPieces:
    """Ids of one word after another, by merging the neighbours that the vocabulary merges first until none is left."""

    def __init__(self, tokenizer_json: str) -> None:
        model = json.loads(tokenizer_json)["model"]
        self.ids, self.signs = model["vocab"], byte_signs()
        self.rank = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}

    def __call__(self, word: str) -> list[int]:
        symbols = [self.signs[b] for b in word.encode()]
        symbols[-1] += WORD_END
        while len(symbols) > 1:
            best = min(zip(symbols, symbols[1:], strict=False), key=lambda pair: self.rank.get(pair, len(self.rank)))
            if best not in self.rank:
                break
            merged, at = [], 0
            while at < len(symbols):
                both = tuple(symbols[at : at + 2]) == best
                merged.append("".join(best) if both else symbols[at])
                at += 1 + both
            symbols = merged
        return [self.ids[s] for s in symbols]


def clip_tokens(texts: DataFrame, tokenizer_json: str, length: int = 77, start: int = 49406, end: int = 49407) -> DataFrame:
    """id, tokens: start, ids, end, padded with 0 to ``length``; longer ones are cut there and lose the end mark.

    Texts (id, text) are split into words, every distinct word is encoded once, and texts get their words' ids by a join.
    Of a text only the first ``length`` words are looked at, as each has a token at least.  Ids of texts are distinct; signs
    are taken as they are written, so composed and decomposed letters differ.
    """
    sent = texts.sparkSession.sparkContext.broadcast(tokenizer_json)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = WordPieces(sent.value)
        for pdf in frames:
            yield pd.DataFrame({"word": pdf.word, "ids": pdf.word.map(pieces)})

    clean = F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " "))
    words = F.slice(F.regexp_extract_all(clean, F.lit(TOKEN_WORDS), F.lit(0)), 1, length)
    rows = texts.select("id", F.posexplode(words).alias("at", "word"))
    known = rows.select("word").distinct().mapInPandas(run, "word string, ids array<int>")
    found = rows.join(known, "word").groupBy("id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "ids"))), lambda w: w["ids"])).alias("ids"))
    x = texts.select("id").join(found, "id", "left").withColumn("ids", F.coalesce("ids", F.expr("cast(array() as array<int>)")))
    padded = F.concat(F.array(F.lit(start)), "ids", F.array(F.lit(end)), F.array_repeat(F.lit(0), length))
    return x.select("id", F.slice(padded, 1, length).alias("tokens"))
