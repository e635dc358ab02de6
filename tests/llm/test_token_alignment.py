"""Alignment of two tokenizers against a plain one, token by token, over whole tables and odd texts."""

import hashlib
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from saltmarsh.llm import queries, token_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(rows):
    """The rows of the contract, from the tokenizers' own libraries and sets of offsets."""
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = sentencepiece.SentencePieceProcessor(model_file=B)
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    byte = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}
    found = []
    for doc, text in rows:
        groups = []
        if text:
            a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
            left = [bytes(byte[c] for c in one.id_to_token(k)) for k in a]
            right = [bytes([int(p[3:5], 16)]) if two.is_byte(k) else p.replace("▁", " ").encode() for k in b for p in [two.id_to_piece(k)]]
            if b"".join(left) == b"".join(right) == (" " + text).encode():
                a_ends, b_ends = list(accumulate(map(len, left))), list(accumulate(map(len, right)))
                both = sorted(set(a_ends) & set(b_ends))
                i = j = 0
                for end in both:
                    k, m = a_ends.index(end, i) + 1, b_ends.index(end, j) + 1
                    groups.append((a[i:k], b[j:m]))
                    i, j = k, m
        found.append((doc, groups, [(x, y) for xs, ys in groups for x in xs for y in ys]))
    counts = Counter(pair for _, _, links in found for pair in set(links))
    best = {}
    for (x, _), n in counts.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for doc, groups, links in found:
        told = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        sha = hashlib.sha256(told.encode()).hexdigest() if groups else ""
        n_best = sum(counts[p] == best[p[0]] for p in links)
        out.append((doc, sum(len(xs) for xs, _ in groups), sum(len(ys) for _, ys in groups), len(groups), len(links), n_best, sum(counts[p] for p in links), sha))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()), key=str)


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert got(queries.QUERIES["op13_token_alignment"](spark, folder)) == plain([(r.doc_id, r.text) for r in docs.collect()])


ODD = [None, "", " ", "  two  spaces ", "▁ piece mark", "<unk></s><s> <|endoftext|> <0x41>", "中文字符 和 한국어", "😀😀é́", "\x00\t\r\n\u0085 ", "x" * 30_000, "ab" * 5_000 + " " * 3_000 + "ab", "\n" * 1_500 + "end", "Ａ ﬁ ①", "same same", "same same", "same same"]


@pytest.mark.parametrize("block", [24_000_000, 1])
def test_odd_texts(spark, block, monkeypatch):
    """Nulls, marks, bytes, runs, one group of many links; with block=1 each batch is a block, over several parts."""
    rows = [(k, t) for k, t in enumerate(ODD)] + [(3, "a repeated id"), (None, "no id")]
    monkeypatch.setattr(token_alignment, "PART", 2 if block == 1 else 1024)
    docs = spark.createDataFrame([(i, t, "k", 1, 2) for i, t in rows], "doc_id long, text string, pairs string, block int, bucket int").repartition(6)
    assert got(token_alignment.alignment(docs, A, public_tokenizers.PATTERN, B, block_bytes=block)) == plain(rows)


def test_chunks_of_a_batch(spark, monkeypatch):
    monkeypatch.setattr(token_alignment, "CHUNK", 100)
    texts = [f"word{k} number {k * 7919}" * (k % 5) for k in range(60)]
    batch = token_alignment.pa.RecordBatch.from_pydict({"id": list(range(60)), "text": texts})
    parts = list(token_alignment._chunks(batch))
    assert [t for _, some in parts for t in some] == texts and [i for ids, _ in parts for i in ids.to_pylist()] == list(range(60)) and len(parts) > 5


def test_other_ids_and_none(spark):
    docs = spark.createDataFrame([("x1", "some text"), ("x2", "some text")], "doc_id string, text string")
    want = [(f"x{i}", *r[1:]) for i, r in zip((1, 2), plain([(1, "some text"), (2, "some text")]))]
    assert got(token_alignment.alignment(docs, A, public_tokenizers.PATTERN, B)) == want
    assert token_alignment.alignment(docs.limit(0), A, public_tokenizers.PATTERN, B).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert got(token_alignment.alignment(nothing, A, public_tokenizers.PATTERN, B)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]
