import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from itemrec.llm import bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = bpe.load_ranks(PATH)
MODEL = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
TABLE = bpe.merges(PATH)


def ids(texts):
    return [np.frombuffer(x, "<u4").tolist() for x in bpe.encode_block(texts, PATTERN, TABLE)]


@pytest.mark.parametrize("text", [
    "", " ", "  ", "a  b", "a \n b", " lead", "trail ", "don't 'tis we'll", "\t\tx", "a\n\nb c", "aaaaaaaaaaaaaaa", "é ü ñ 漢字 🙂 x", "<|endoftext|>", "1 22 333", " x 　y", "x  y", "abababab" * 40,
])
def test_like_the_model(text):
    assert ids([text]) == [MODEL.encode_ordinary(text)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é'st \n\t.,1漢 "), max_size=60), max_size=6))
def test_any_text(texts):
    assert ids(texts) == [MODEL.encode_ordinary(t) for t in texts]


def test_merges_out_of_rank_order():
    """A vocabulary in which a merge opens one of lesser rank before the word's next place."""
    ranks = {bytes([b]): b for b in range(256)} | {b"xyz": 256, b"ab": 260, b"abc": 257, b"xy": 261, b"aba": 258}
    table = bpe.Merges(ranks)
    words = [b"abcab", b"ababc", b"xyzxy", b"abab", b"xyxyz"]
    assert [x.tolist() for x in bpe.replay(words, table)] == [bpe.merge_word(w, ranks) for w in words]


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in bpe.digests(bpe.encode(docs, PATH, PATTERN, block_chars=50_000)).collect():
        own = MODEL.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(own)
        assert r.ids_sha256 == hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "y"), (2, "again", "z"), (2, "again", "z"), (None, "no id", "w"), (3, "long " * 300_000, "v")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    found = sorted(((r.doc_id, bytes(r.decoded).decode()) for r in bpe.encode(df, PATH, PATTERN).collect()), key=str)
    assert found == sorted([(i, t or "") for i, t, _ in rows], key=str)
    assert bpe.encode(df.limit(0), PATH, PATTERN).collect() == []
