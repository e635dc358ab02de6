import hashlib

import public_tokenizers
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from saltmarsh.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
PLAIN = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.ranks_of(PATH), special_tokens={})
ODD = " \t\n\x0b\x1c\x1f\x85\xa0\u1680\u180e\u2000\u2003\u200a\u200b\u2028\u2029\u202f\u205f\u3000\ufeff'sAz09.,\xe9"
TEXTS = st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(ODD)), max_size=50)


@settings(max_examples=500, deadline=None)
@given(TEXTS)
def test_parts_encode_apart(text):
    parts = byte_bpe.PART.findall(text)
    assert "".join(parts) == text
    assert [i for p in parts for i in PLAIN.encode_ordinary(p)] == PLAIN.encode_ordinary(text)


def test_squeezing():
    import numpy as np

    for values in ([], [0], [5, 70_000, 2**32 - 1] * 1000):
        assert byte_bpe.widened(byte_bpe.squeezed(np.array(values, dtype=np.int64))).tolist() == values
    for parts in ([], [b""], [b"a", b"", b"\x00\xff" * 999]):
        assert byte_bpe.widened_strings(byte_bpe.squeezed_strings(parts)) == parts


def same(spark, rows, **how):
    docs = spark.createDataFrame([(i, t, 0, "x") for i, t in rows], "doc_id long, text string, ids int, block string").repartition(3)
    got = byte_bpe.decode(byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN, **how), PATH).collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=key) == sorted(((i, PLAIN.encode_ordinary(t or "")) for i, t in rows), key=key)
    for r in got:
        assert bytes(r.decoded) == PLAIN.decode_bytes(list(r.ids))
    return got


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " "), (3, " "), (None, "null id"), (4, "a  b\n\n c\t"), (5, "word " * 30_000), (6, "x" * 5000), (7, "\x00 \x1c y")]
    same(spark, rows)
    same(spark, rows, buckets=1, block_chars=10)
    assert same(spark, []) == []


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    got = same(spark, rows, block_chars=50_000)
    texts = dict(rows)
    assert all(hashlib.sha256(bytes(r.decoded)).digest() == hashlib.sha256(texts[r.doc_id].encode()).digest() for r in got)
