"""Quality rules: a linear-chain CRF labels lines as content or boilerplate, and the content share decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = "#*$%&|<>"
BLANK = " \t\n\x0b\x0c\r"
CLOSING = (b".", b"!", b"?", b":", b";", b",", b'"', b")")
#: Line features are cuts of a few ratios; FEATURES is how many indicator bits they have in all.
FEATURES = 29


def line_features(line: bytes, words: list[bytes], seen: bool) -> int:
    """Indicator bits of a line with words: its length, symbols, case, repetition, digits, ending, and if seen before."""
    n = len(words)
    text = line.decode()
    letters = sum(map(str.isalpha, text)) or 1
    symbols = sum(text.count(c) for c in SYMBOLS) / n
    upper = sum(map(str.isupper, text)) / letters
    repeated = sum(a == b for a, b in zip(words, words[1:], strict=False)) / n
    distinct = len(set(words)) / n
    digits = sum(map(str.isdigit, text)) / (letters + 1)
    marks = text.count("!") / n
    mean = len(text) / n
    bits, at = 0, 0
    for value, cuts in (
        (n, (3, 6, 13)),
        (symbols, (0.001, 0.1, 0.5)),
        (upper, (0.35, 0.7)),
        (repeated, (0.05, 0.3)),
        (distinct, (0.2, 0.5)),
        (digits, (0.1, 0.5)),
        (marks, (0.1, 0.5)),
        (mean, (3, 12, 25)),
    ):
        bits |= 1 << at + sum(value >= c for c in cuts)
        at += len(cuts) + 1
    if line.rstrip().endswith(CLOSING):
        bits |= 1 << at
    return bits | seen << at + 1


def text_lines(text: bytes) -> tuple[list[int], list[int], int]:
    """Features and numbers of words of each line that has a word, and how many equal an earlier one."""
    features, sizes, seen, copies = [], [], set(), 0
    for line in text.split(b"\n"):
        words = line.split()
        if words:
            again = line in seen
            copies += again
            seen.add(line)
            features.append(line_features(line, words, again))
            sizes.append(len(words))
    return features, sizes, copies


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside a window of words that the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    key = ids[:n]
    for k in range(1, window):
        _, key = np.unique(key * len(numbers) + ids[k : n + k], return_inverse=True)
    twice = np.bincount(key)[key] > 1
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : n + k] |= twice
    return int(covered.sum())


class Crf:
    """Two labels: 0 boilerplate, 1 content. weights: features by label; moves: label by next label."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves

    def scores(self, features: np.ndarray) -> np.ndarray:
        return _bits(features) @ self.weights

    def decode(self, features: list[int]) -> list[int]:
        """Viterbi: the best labels of a text's lines; content wins a tie."""
        if not features:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        scores = self.scores(np.array(features, np.int64)).tolist()
        a, b = scores[0]
        back = []
        for x, y in scores[1:]:
            to0, to1 = (b + m10 >= a + m00), (b + m11 >= a + m01)
            back.append((to0, to1))
            a, b = x + (b + m10 if to0 else a + m00), y + (b + m11 if to1 else a + m01)
        label = int(b >= a)
        labels = [label]
        for step in reversed(back):
            label = int(step[label])
            labels.append(label)
        return labels[::-1]


def _bits(features: np.ndarray) -> np.ndarray:
    return (features[:, None] >> np.arange(FEATURES) & 1).astype(np.float64)


def train(texts: list[list[int]], labels: list[int], rounds: int = 2, steps: int = 120, ridge: float = 1.0) -> Crf:
    """A CRF for lines from labels of whole texts (1 good, 0 bad).

    Lines first have the label of their text. After a first fit, lines of bad texts that are content by their own
    features are taken for content, and the CRF is fitted again. Fits are by gradient steps on the penalised likelihood.
    """
    kept = [(t, y) for t, y in zip(texts, labels, strict=True) if t]
    if not kept or len({y for _, y in kept}) < 2:
        return Crf(np.zeros((FEATURES, 2)), np.zeros((2, 2)))
    longest = max(len(t) for t, _ in kept)
    feats = np.zeros((len(kept), longest), np.int64)
    real = np.zeros((len(kept), longest), bool)
    truth = np.zeros((len(kept), longest), np.int64)
    for k, (t, y) in enumerate(kept):
        feats[k, : len(t)], real[k, : len(t)], truth[k, : len(t)] = t, True, y
    crf = Crf(np.zeros((FEATURES, 2)), np.zeros((2, 2)))
    bad = np.array([y == 0 for _, y in kept])[:, None] & real
    for k in range(rounds):
        crf = _fit(feats, real, truth, steps, ridge)
        if k < rounds - 1:
            own = crf.scores(feats[bad])
            truth[bad] = own[:, 1] - own[:, 0] > 0
    return crf


def _fit(feats: np.ndarray, real: np.ndarray, truth: np.ndarray, steps: int, ridge: float) -> Crf:
    n, longest = feats.shape
    bits = _bits(feats.ravel()).reshape(n, longest, FEATURES) * real[..., None]
    flat = bits.reshape(-1, FEATURES)
    onehot = np.stack([truth == 0, truth == 1], -1) * real[..., None]
    pairs = real[:, 1:] & real[:, :-1]
    want_w = flat.T @ onehot.reshape(-1, 2)
    want_m = np.einsum("nta,ntb->ab", onehot[:, :-1] * pairs[..., None], onehot[:, 1:] * 1.0)
    theta = np.zeros(FEATURES * 2 + 4)
    first, second, total = np.zeros_like(theta), np.zeros_like(theta), real.sum()
    for step in range(1, steps + 1):
        weights, moves = theta[:-4].reshape(FEATURES, 2), theta[-4:].reshape(2, 2)
        emit = (flat @ weights).reshape(n, longest, 2)
        alpha, beta = np.zeros((n, longest, 2)), np.zeros((n, longest, 2))
        alpha[:, 0] = emit[:, 0]
        for t in range(1, longest):
            go = np.logaddexp(alpha[:, t - 1, 0, None] + moves[0], alpha[:, t - 1, 1, None] + moves[1]) + emit[:, t]
            alpha[:, t] = np.where(real[:, t, None], go, alpha[:, t - 1])
        whole = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        for t in range(longest - 2, -1, -1):
            ahead = emit[:, t + 1] + beta[:, t + 1]
            go = np.logaddexp(moves[:, 0] + ahead[:, 0, None], moves[:, 1] + ahead[:, 1, None])
            beta[:, t] = np.where(real[:, t + 1, None], go, 0)
        one = np.exp(alpha + beta - whole[:, None, None]) * real[..., None]
        two = np.exp(alpha[:, :-1, :, None] + moves + (emit + beta)[:, 1:, None, :] - whole[:, None, None, None]) * pairs[..., None, None]
        grad = np.concatenate([(want_w - flat.T @ one.reshape(-1, 2)).ravel(), (want_m - two.sum((0, 1))).ravel()]) - ridge * theta
        grad /= total
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta = theta + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return Crf(theta[:-4].reshape(FEATURES, 2), theta[-4:].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_texts: int = 800, most_lines: int = 50) -> Crf:
    """A CRF from a bounded sample of labelled documents: those with the most_texts smallest hashes of their
    ids, and their first most_lines lines each. Only line features reach the driver.

    Labels that are null are no labels; of several for a document the smallest holds, and of several
    texts with one id one counts, so that no more than most_texts rows reach the driver. Without labels of both kinds every line
    counts as content.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("string").alias("id")).agg(F.min(label_col).cast("int").alias("label"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(most_texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [text_lines((t.as_py() or "").encode())[0][:most_lines] for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lines, pa.list_(pa.int64()))], ["id", "label", "lines"])

    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(sample), "id").select("id", "label", "text").mapInArrow(run, "id string, label int, lines array<long>")
    rows = found.groupBy("id", "label").agg(F.min("lines").alias("lines")).toArrow().to_pylist()
    rows.sort(key=lambda r: r["id"])
    return train([r["lines"] for r in rows], [r["label"] for r in rows])


def judge(text: str, crf: Crf, min_share: float = 0.5, min_words: int = 50, most_repeated: int = 50) -> tuple:
    """n_words to content_share of judged(), for one text."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in BLANK)
    features, sizes, copies = text_lines(raw)
    again = repeated_words(words)
    failed = n < min_words or 100 * again > most_repeated * n
    share = sum(s for s, y in zip(sizes, crf.decode(features), strict=True) if y) / n if n else None
    return n, chars, sum(text.count(c) for c in SYMBOLS), copies, again, failed, not failed and share >= min_share, len(sizes), share


def judged(
    docs: DataFrame,
    crf: Crf,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_share: float = 0.5,
    min_words: int = 50,
    most_repeated: int = 50,
) -> DataFrame:
    """id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lines, content_share.

    A text fails at once with fewer than min_words words, or over most_repeated percent of its words in
    repeated windows of three. Others are kept if lines that Viterbi decoding labels content hold
    min_share of their words or more. Works row by row, on whole texts, without a shuffle.

    Null or empty text: no words, failed; content_share is null without words. Null or repeated ids: each row has its result;
    ids keep their type.
    Empty table: empty result. Other columns are ignored.
    """
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "content_share"]
    types = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [judge(t.as_py() or "", crf, min_share, min_words, most_repeated) for t in batch.column(1)]
            columns = [batch.column(0)] + [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names)

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {texts.schema['id'].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, content_share double"
    return texts.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all their columns. Each row is judged by its own text, whatever its id."""
    crf, at = fit(docs, labels, id_col, text_col), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([judge(t.as_py() or "", crf)[6] for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
