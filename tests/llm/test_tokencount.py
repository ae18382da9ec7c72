from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from textloom.llm import tokencount

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 1 << 11), (300, 40), (64, 8)])
def test_counts_are_the_librarys(docs, texts, chunk, overlap):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = Counter((i, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 200) for i, t in texts)
    got = Counter(tuple(r) for r in tokencount.token_counts(docs, PATH, 200, chunk, overlap).collect())
    assert got == want


def test_a_text_without_any_boundary_is_taken_whole(spark):
    text = "aaaaab" * 3000
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert tokencount.token_counts(df, PATH, chunk_chars=256, overlap_chars=16).first().n_tokens == len(model.encode(text))


def test_empty(no_docs):
    assert tokencount.token_counts(no_docs, PATH).count() == 0
