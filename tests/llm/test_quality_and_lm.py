import math
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from saltmarsh.llm import crf_quality, lm_scoring

BLANKS = "\t\n\x0b\x0c\r "


def plain_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        if c in BLANKS:
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


def plain_base(text):
    words = plain_words(text)
    lines, again = [x for x in (text or "").split("\n") if plain_words(x)], 0
    for k, line in enumerate(lines):
        again += line in lines[:k]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered)


TEXTS = [None, "", " \n ", "a b c", "a a a a", "x y z x y z q", "é ü\x85 ß\nx\nx \nx\n\n", "#a |b <c> d$\n" * 40, "word " * 100_000, "A clean sentence of plain words stands here.\n" * 2]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abé \n\t|#\x85\xa0", max_size=80))
def test_base_counts(text):
    words = text.encode().split()
    _, _, copies = crf_quality.text_lines(text.encode())
    assert (len(words), copies, crf_quality.repeated_words(words)) == tuple(plain_base(text)[k] for k in (0, 3, 4))


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(1)
    for n in range(1, 8):
        crf = crf_quality.Crf(rng.normal(size=(crf_quality.FEATURES, 2)), rng.normal(size=(2, 2)))
        lines = [int(x) for x in rng.integers(0, 1 << crf_quality.FEATURES, n)]
        scores = crf.scores(np.array(lines))
        value = lambda ys: sum(scores[k, y] for k, y in enumerate(ys)) + sum(crf.moves[a, b] for a, b in zip(ys, ys[1:]))
        assert value(crf.decode(lines)) == pytest.approx(max(value(ys) for ys in product((0, 1), repeat=n)))
    assert crf.decode([]) == []


def test_gradient_reaches_the_labels():
    good, bad = 1, 2
    crf = crf_quality.train([[good] * 4, [bad] * 4, [good] * 3, [bad, bad]], [1, 0, 1, 0], ridge=0.01)
    assert crf.decode([good, good, bad]) [:2] == [1, 1] and crf.decode([bad] * 3) == [0, 0, 0]


def test_judged_columns(spark):
    docs = spark.createDataFrame([(k, t, "x", True) for k, t in enumerate(TEXTS)] + [(None, "a b", "x", True), (3, "a b c", "x", False)], "doc_id long, text string, n_words string, kept boolean")
    rows = crf_quality.judged(docs, crf_quality.train([], [])).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        if r.doc_id is None:
            assert r.n_words == 2
            continue
        want = plain_base(TEXTS[r.doc_id]) if len(TEXTS[r.doc_id] or "") < 10_000 else (100_000, 400_000, 0, 0, 100_000)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert crf_quality.judged(docs.limit(0), crf_quality.train([], [])).count() == 0


def test_held_out_labels(spark):
    """Fitted on some labelled documents, right on the others that pass the base rules."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    crf = crf_quality.fit(docs, labels.where("doc_id % 2 = 0"))
    rows = crf_quality.judged(docs, crf).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [not r.kept for r in rows if r.quality == 0]
    assert len(good) > 50 and sum(good) / len(good) >= 0.98 and sum(bad) / max(1, len(bad)) >= 0.9
    nothing = crf_quality.fit(docs, labels.limit(0))
    assert crf_quality.judged(docs, nothing).where("kept = base_failed").count() == 0


def plain_scores(rows, strength):
    """Bigram losses of (text, is_target) rows, with every word and pair in the models."""
    texts = [plain_words("".join(c.lower() if c.isascii() else c for c in t or "")) for t, _ in rows]
    vocabulary = {w for t in texts for w in t}
    size = len(vocabulary) + 1
    models = []
    for which in ([t for t, (_, good) in zip(texts, rows) if good], texts):
        one, two = Counter(w for t in which for w in t), Counter(p for t in which for p in zip(t, t[1:]))
        total = sum(one.values())
        models.append((one, two, lambda w, one=one, total=total: (one[w] + 1) / (total + size)))
    out = []
    for t in texts:
        means = []
        for one, two, single in models:
            loss = [-math.log(single(w) if k == 0 else (two[t[k - 1], w] + strength * single(w)) / (one[t[k - 1]] + strength)) for k, w in enumerate(t)]
            means.append(sum(loss) / len(loss) if loss else None)
        out.append((len(t), *means))
    return out


def test_good_documents_score_lower(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    mean = lm_scoring.cross_entropy_difference(docs, labels).join(labels, "doc_id").groupBy("quality").avg("score")
    by = {r.quality: r["avg(score)"] for r in mean.collect()}
    assert by[1] < by[0]
    assert lm_scoring.cross_entropy_difference(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize(("block", "bucket"), [(40, 9000), (1 << 30, 20_000)])
def test_every_ngram_and_every_good_document_counts(spark, monkeypatch, block, bucket):
    """Rare words and pairs beside common ones, in blocks and buckets of several sizes, against plain models; null, repeated and text ids."""
    monkeypatch.setattr(lm_scoring, "BLOCK_BYTES", block)
    monkeypatch.setattr(lm_scoring, "BUCKET_TOKENS", bucket)
    common = "the word of the day " * 20_000
    rows = [("0", common, 1), ("1", "rare pair here", 1), ("2", "rare pair there", 0), ("3", None, 1), ("4", "", None), ("5", "one", 1), ("6", "The DAY of rare", None), (None, "here the day", None), ("6", "one day", None)]
    docs = spark.createDataFrame([(*r[:2], 1, 2) for r in rows], "doc_id string, text string, block int, score int")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows if q is not None] + [("1", 0), (None, 1)], "doc_id string, quality int")
    got = sorted(((r.doc_id or "-", r.n_tokens, r.target_loss or 0, r.background_loss or 0, r.score or 0) for r in lm_scoring.cross_entropy_difference(docs, labels).collect()))
    plain = plain_scores([(t, q == 1) for _, t, q in rows], 20.0)
    want = sorted((i or "-", n, t or 0, b or 0, (t or 0) - (b or 0)) for (i, _, _), (n, t, b) in zip(rows, plain, strict=True))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:2] == w[:2] and g[2:] == pytest.approx(w[2:])


def test_whole_table_against_plain_models(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = {i: x for (i, _), x in zip(rows, plain_scores([(t, i in good) for i, t in rows], 20.0), strict=True)}
    got = lm_scoring.cross_entropy_difference(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_tokens, r.target_loss, r.background_loss) == pytest.approx(want[r.doc_id])


def test_counts_past_32_bits():
    values = np.array([0, 1, 254, 255, 256, 2**32 - 1, 2**32, 2**40 + 7], np.int64)
    assert lm_scoring._whole(lm_scoring._wide(values)).tolist() == values.tolist()
