import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from shiftlens.llm.tokens import Merger, count_tokens

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))
PARTS = [" ", "  ", "\n", "\t", "▁", "a", "the", "ing", "é", "日本", "\U0001f600", "<s>", "</s>", "<unk>", "<0x0A>", "\x00", "0", "'", "\r", "　", "_", "²", ".", "*", ",", '"', "C++"]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=MODEL)


def test_counts_as_the_library_does(library):
    rng, merger = random.Random(5), Merger(MODEL)
    for _ in range(5000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        assert merger.count(text) == len(library.encode(text)), repr(text)


def test_long_text_without_spaces(library):
    text = "abracadabra" * 5000
    assert Merger(MODEL).count(text) == len(library.encode(text))


def test_query_shape_and_edge_rows(spark, library):
    texts = [None, "", "a b", "a b", "word " * 5000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "q", "x")], "doc_id long, text string, n_tokens string")
    got = sorted(map(tuple, count_tokens(docs, MODEL).collect()), key=str)
    want = sorted([(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t in [*enumerate(texts), (None, "q")]], key=str)
    assert got == want
    assert count_tokens(docs.limit(0), MODEL).count() == 0
