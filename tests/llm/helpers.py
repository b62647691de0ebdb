"""Small tables with all the awkward rows, and plain versions of what operators compute."""

import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text, lower=False):
    data = (text or "").encode()
    if lower:
        data = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    return WORD.findall(data)


AWKWARD = [
    (1, "The cat sat on the mat and looked at the moon tonight", "en", "a", 1),
    (2, "the CAT sat on the mat and looked at the moon tonight", "en", "a", 1),
    (3, None, "en", "a", None),
    (4, "", None, None, 0),
    (5, " \t\n\x0b ", "de", "b", 5),
    (6, "one two", "en", None, 7),
    (7, "one  two", "en", "b", 7),
    (8, "é x y \u0000 z▁▁ 😀", "fr", "é", 3),
    (9, "long " * 30_000 + "end", "en", "a", 2),
    (9, "a repeated id", "en", "a", 2),
    (10, "a repeated row of five words more", "en", "b", 2),
    (10, "a repeated row of five words more", "en", "b", 2),
    (None, "no id at all here today", "en", "c", 2),
    (11, "x", "en", "c", 2),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def awkward(spark):
    """Rows with more columns, some named as operators name theirs."""
    df = spark.createDataFrame(AWKWARD, COLUMNS)
    names = (
        "size", "node", "n_shingles", "score", "shard", "taken", "id", "copy", "n", "quality_score", "text_to_score", "text_to_encode", "key_to_encode", "pieces", "decoded_crc32", "text_to_count", "text_to_join",
        "n_words", "n_tokens", "root", "component_id", "key_of_text", "kept_id", "kept_key", "text_key", "content", "row", "times", "level", "block", "middle", "slot", "old_shard",
    )
    return df.selectExpr("*", *(f"'{name}' as {name}" for name in names))


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
