import random
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm.tokenize import TOKENIZER_DIR, TreeEncoder, encode_corpus

FILE = Path(TOKENIZER_DIR) / "byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not FILE.exists(), reason="no tokenizer files")
ENC = TreeEncoder(str(FILE), leaf_chars=8, window=4) if FILE.exists() else None


def whole(text):
    return ENC.tok.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 'resltmvd\n\t09é漢🙂​ <|endoftext|>!")), max_size=120))
def test_tree_equals_whole(text):
    (ids,) = ENC.encode_many([text])
    assert ids == whole(text)
    assert ENC.decode(ids) == text


@pytest.mark.parametrize("text", ["a" * 5000, " " * 3000, "\n" * 99 + "x", "<|endoftext|>" * 90, "7" * 999, "'re 's ' t" * 200, "é" * 1000])
def test_long_runs(text):
    assert ENC.encode_many([text])[0] == whole(text)


def test_order_of_random_texts_and_batches():
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab c\n'd") for _ in range(rnd.randint(0, 200))) for _ in range(200)]
    assert ENC.encode_many(texts) == [whole(t) for t in texts]


def test_corpus(spark):
    rows = [(1, "Hello <|endoftext|> world", "x"), (2, "", "x"), (3, None, None), (1, "Hello <|endoftext|> world", "x"), (4, "word " * 3000, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")  # a column that clashes with the result's
    got = sorted((r["doc_id"], list(r["ids"])) for r in encode_corpus(df, leaf_chars=64, batch_chars=100).collect())
    assert got == sorted((i, whole(t or "")) for i, t, _ in rows)
    assert encode_corpus(df.where("false")).count() == 0
