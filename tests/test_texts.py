"""Token ids by words beside a library that goes over whole texts."""

import random
import unicodedata

from tokenizers import Tokenizer

from orrery.operators import text as W

PATH = "/opt/tokenizers/word_bpe_49k.json"


def test_tokens_of_texts(spark):
    rng = random.Random(2)
    parts = ["The", "cat's", "we'll", "naïve", "3rd", "12,5", "№", "日本語", "👩‍👩‍👧", "...", "<|endoftext|>", "é", " ", "\t", "ÀÉ", "x_y", "don't!!", "straße"]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(100).collect()]
    texts = [unicodedata.normalize("NFC", t) for t in texts]
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    with open(PATH) as file:
        found = {r.id: list(r.tokens) for r in W.clip_tokens(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), file.read()).collect()}
    assert len(found) == len(texts)
    for i, t in enumerate(texts):
        ids = tokenizer.encode(" ".join(t.split()), add_special_tokens=False).ids
        want = ([49406, *ids, 49407] + [0] * 77)[:77]
        assert found[i] == want, t


def test_byte_signs():
    signs = W.byte_signs()
    assert len(set(signs)) == 256 and signs[ord("A")] == "A" and signs[0] == chr(256) and signs[32] == chr(288)
