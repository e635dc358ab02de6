import random
import struct
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from saltmarsh.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
PLAIN = Tokenizer.from_file(PATH)


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \t\n\x0b\x1c\x85\xa0 ΣσİiA'ś<|endoftext|>")), max_size=40))
def test_ids_are_the_library_s(text):
    assert packing.WordTokenizer(PATH)([text.encode(), b"word"]) == [packing._packed(plain_ids(text)), packing._packed(plain_ids("word"))]


def test_special_tokens_in_texts():
    for text in ("a <|startoftext|> b", "x<|startoftext|>y <|endoftext|>", "<|startoftext|>"):
        assert packing.WordTokenizer(PATH)([text.encode(), b"next"])[0] == packing._packed(plain_ids(text))


def checked(rows, docs, longest=2048):
    """Every id in one piece, offsets without gaps; the padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for doc_id, text in docs.items():
        ids = plain_ids(text) + [1]
        pieces = sorted(by_doc.pop(doc_id), key=lambda r: r.start)
        assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        assert b"".join(p.ids for p in pieces) == struct.pack(f"<{len(ids)}I", *ids)
        assert all(len(p.ids) == 4 * p.length and p.length > 0 and p.doc_tokens == len(ids) for p in pieces)
    assert not by_doc
    padding = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
        n = sum(p.length for p in pieces)
        assert n == pieces[0].sequence_length <= longest
        padding += 0 if n & (n - 1) == 0 else longest - n
    return padding


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = packing.packed(docs, PATH).collect()
    assert checked(rows, texts) == 0
    steps = defaultdict(lambda: defaultdict(int))
    for r in rows:
        steps[r.sequence_length][r.step_group] += r.length
    for length, groups in steps.items():
        assert max(groups.values()) - min(groups.values()) <= length * 2 or len(groups) < 4


def test_edge_cases(spark):
    texts = {1: None, 2: "", 3: "word", 4: "wide " * 50_000, 5: "\n \t", 6: "a<|endoftext|>b"}
    docs = spark.createDataFrame([(k, t, 0, "x") for k, t in texts.items()], "doc_id long, text string, start int, ids string")
    assert checked(packing.packed(docs.coalesce(1), PATH, hold_tokens=100).collect(), texts) == 0
    assert packing.packed(docs.limit(0), PATH).count() == 0
    twice = packing.packed(docs.where("doc_id = 3").unionByName(docs.where("doc_id = 3")), PATH)
    assert [r.doc_tokens for r in twice.collect()] == [2, 2]


@pytest.mark.parametrize("lengths", [[1], [2047, 1], [2048], [255, 257, 600, 1500, 3, 9000], [300] * 50])
def test_packer_uses_each_token_once(lengths):
    packer, windows = packing.Packer(packing.TIERS), []
    for k, n in enumerate(lengths):
        windows += packer.add(k, n)
    windows += packer.flush()
    used = sorted((d, s, n) for w in windows for d, s, n in w)
    for k, length in enumerate(lengths):
        at = 0
        for d, s, n in used:
            if d == k:
                assert s == at
                at += n
        assert at == length
    assert all((n := sum(p[2] for p in w)) & (n - 1) == 0 and n <= 2048 for w in windows)


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("x1", "some words"), (None, None), ("x1", "some words")], "doc_id string, text string")
    found = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert {(r.doc_id, r.doc_tokens) for r in found} == {(None, 1), ("x1", 3)} and sum(r.length for r in found) == 7


def test_plain_words_by_the_quicker_way():
    """Words of plain letters have the ids of the tokenizer's own library, pieces, case and marks included."""
    path = public_tokenizers.path("word_bpe_49k.json")
    own, ours = Tokenizer.from_file(path), packing.WordTokenizer(path)
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZ0123456789'!?.,-_/()<>|éèñüßöÉÑ×ªµ\0İΣ漢"
    words = ["".join(rng.choices(letters, k=rng.randrange(1, 16))) for _ in range(20_000)] + ["it's", "'s", "<|endoftext|>", "a<|b", "x" * 5000, "ﬁ", "é", "ΑΣ"]
    got = [ours([w.encode()])[0] for w in words[-200:]] + ours([w.encode() for w in words[:-200]])
    want = own.encode_batch(words[-200:] + words[:-200], add_special_tokens=False)
    assert got == [packing._packed(x.ids) for x in want]
