"""Quality: EM weighs overlapping heuristic labellers, and their posterior trains a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corbel.llm.boosting import sigmoid
from corbel.llm.wordhash import BLANK_WORDS, words_by_block
from corbel.workspace import Workspace

#: Documents, about so many and chosen by hash, on which the linear scorer is fitted.
TRAIN_DOCS = 2_000
#: A text is rejected when its log-odds of being good are below this (about one in nine): doubtful texts stay.
REJECT_BELOW = -2.2
#: Slots of the scorer's weights.
SLOTS = 1 << 14
LABELLERS = ("symbols", "capitals", "shouts", "bars", "repeats", "variety", "prose")
#: A labeller votes bad above its bound and otherwise good; EM learns what either vote is worth.
BOUNDS = {"symbols": 0.1, "capitals": 0.5, "shouts": 0.15, "bars": 0.1, "repeats": 0.25, "variety": 0.8, "prose": 0.3}
#: In texts with fewer words repetition and variety say nothing bad.
ENOUGH_WORDS = 20

_UPPER, _LOWER, _DIGIT, _SYMBOL, _BANG, _BAR = (np.zeros(256, bool) for _ in range(6))
_UPPER[0x41:0x5B] = _LOWER[0x61:0x7B] = _DIGIT[0x30:0x3A] = True
_SYMBOL[[ord(c) for c in "#$%&*@^~<>=_+\\{}[]"]] = True
_BANG[ord("!")] = _BAR[ord("|")] = True


class _Words:
    """Per word counts of byte classes, for the rows of one block."""

    def __init__(self, raw: np.ndarray, split: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray):
        def per_word(of: np.ndarray) -> np.ndarray:
            sums = np.r_[0, np.cumsum(of[raw], dtype=np.int64)]
            return sums[ends] - sums[starts]

        self.split, self.n, self.hashes = split, np.diff(split), hashes
        self.upper, self.lower, self.digit, self.symbol, self.bang, self.bar = (per_word(x) for x in (_UPPER, _LOWER, _DIGIT, _SYMBOL, _BANG, _BAR))
        self.size = ends - starts
        self.again = np.zeros(len(hashes), bool)
        self.again[1:] = hashes[1:] == hashes[:-1]
        self.again[split[:-1][split[:-1] < len(hashes)]] = False

    def total(self, per_word: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(per_word, dtype=np.float64)]
        return sums[self.split[1:]] - sums[self.split[:-1]]

    def measures(self) -> dict[str, np.ndarray]:
        n = np.maximum(self.n, 1)
        letters = np.maximum(self.total(self.upper + self.lower), 1)
        distinct = np.array([len(np.unique(self.hashes[a:b])) for a, b in zip(self.split[:-1], self.split[1:], strict=True)])
        # variety is judged by what a text of its length can have: the square root rule of vocabularies
        expected = np.minimum(n, 2.5 * np.sqrt(n))
        return {
            "symbols": self.total(self.symbol >= 2) / n, "capitals": self.total(self.upper) / letters, "shouts": self.total(self.bang > 0) / n,
            "bars": self.total((self.bar > 0) & (self.size == 1)) / n, "repeats": self.total(self.again) / n, "variety": 1 - np.minimum(1, distinct / expected),
            # words that no sentence has: repeated at once, with symbols or shouts, or all capitals
            "prose": self.total(self.again | (self.symbol + self.bar + self.bang > 1) | (self.bar > 0) | ((self.upper > 1) & (self.lower == 0))) / n,
        }

    def votes(self) -> np.ndarray:
        """True where a labeller votes bad."""
        found = self.measures()
        out = np.stack([found[name] > BOUNDS[name] for name in LABELLERS], axis=1)
        out[self.n < ENOUGH_WORDS, LABELLERS.index("repeats") : LABELLERS.index("variety") + 1] = False
        return out

    def patterns(self) -> np.ndarray:
        return self.votes() @ (1 << np.arange(len(LABELLERS)))

    def slots(self) -> np.ndarray:
        """Two slots for each word: of its shape with repetition, and of itself."""
        shape = np.minimum(self.upper, 3)
        for part, most in ((self.lower, 1), (self.digit, 2), (self.symbol, 3), (self.bang, 2), (self.bar, 1), (self.size // 4, 7), (self.again, 1)):
            shape = shape * (most + 1) + np.minimum(part, most).astype(np.int64)
        mixed = (shape.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
        half = np.uint64(SLOTS // 2 - 1)
        return np.stack([(mixed & half).astype(np.int64), (self.hashes & half).astype(np.int64) + SLOTS // 2], axis=1)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, int, _Words]]:
    column = batch.column("text").cast(pa.large_string()).fill_null("")
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :] if len(column) else np.zeros(1, np.int64)
    for lo, hi, part, _, split, starts, ends, hashes in words_by_block(column, BLANK_WORDS):
        raw = data[offsets[lo] : offsets[lo] + len(part)]
        yield lo, hi, _Words(raw, split, starts, ends, hashes)


def _votes(texts: int):
    """Patterns of votes with their number, one row for each pattern of a batch; then a task's ``texts`` least hashes of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = np.zeros(0, np.int64)
        for batch in batches:
            code = np.concatenate([w.patterns() for *_, w in _blocks(batch)] or [np.zeros(0, np.int64)])
            pattern, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64())], names=["pattern", "n", "rank"])
            least = np.unique(np.concatenate([least, batch.column("rank").to_numpy()]))[:texts]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(least), pa.int64()), pa.nulls(len(least), pa.int64()), pa.array(least)], names=["pattern", "n", "rank"])

    return run


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's vote pattern, its slots and their shares of its words, the last two as bytes."""
    for batch in batches:
        pattern, slot, value = [], [], []
        for _, _, w in _blocks(batch):
            code, slots = w.patterns(), w.slots()
            for r in np.flatnonzero(w.n):
                s, c = np.unique(slots[w.split[r] : w.split[r + 1]], return_counts=True)
                pattern.append(int(code[r]))
                slot.append(s.astype("<i2").tobytes())
                value.append((c / w.n[r]).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.int64()), pa.array(slot, pa.binary()), pa.array(value, pa.binary())], names=["pattern", "slot", "value"])


def posterior(patterns: np.ndarray, counts: np.ndarray, steps: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: P(good | pattern), each labeller's P(bad vote | class), and the share of good texts.

    It starts from the belief that one bad vote makes a bad text.
    """
    votes = patterns[:, None] >> np.arange(len(LABELLERS)) & 1
    good = np.where(votes.any(1), 0.1, 0.95)
    table, share = np.zeros((2, len(LABELLERS))), 0.8
    for _ in range(steps):
        share = float(np.clip((good * counts).sum() / max(1, counts.sum()), 0.02, 0.98))
        for c, weight in ((0, (1 - good) * counts), (1, good * counts)):
            # pseudo-counts: bad votes are likelier on bad texts
            table[c] = ((votes * weight[:, None]).sum(0) + (1.0, 0.1)[c]) / (weight.sum() + 4)
        each = (np.log(table)[:, None, :] * votes + np.log(1 - table)[:, None, :] * (1 - votes)).sum(2)
        good = sigmoid(each[1] + np.log(share) - each[0] - np.log(1 - share))
    return good, table, share


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float
    accuracies: dict[str, tuple[float, float]]
    posterior: dict[int, float]

    def score(self, w: _Words) -> np.ndarray:
        return self.bias + w.total(self.weights[w.slots()].sum(1)) / np.maximum(w.n, 1)


def _linear(rows: list, target: np.ndarray, steps: int = 300, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, classes weighed alike, by accelerated gradient steps."""
    slot, value = (np.frombuffer(b"".join(r[k] for r in rows), kind) for k, kind in (("slot", "<i2"), ("value", "<f4")))
    doc, slot, value = np.repeat(np.arange(len(rows)), [len(r.slot) // 2 for r in rows]), slot.astype(np.int64), value.astype(float)
    balance = np.where(target > 0.5, 0.5 / max(1, (target > 0.5).sum()), 0.5 / max(1, (target <= 0.5).sum()))
    w, b, vw, vb = np.zeros(SLOTS), 0.0, np.zeros(SLOTS), 0.0
    for _ in range(steps):
        p = sigmoid(np.bincount(doc, w[slot] * value, len(rows)) + b)
        d = (p - target) * balance
        vw = 0.9 * vw - 3.0 * (np.bincount(slot, d[doc] * value, SLOTS) + l2 * w / SLOTS)
        vb = 0.9 * vb - 1.0 * d.sum()
        w, b = w + vw, b + vb
    return w, float(b)


def fit_quality(docs: DataFrame, train_docs: int = TRAIN_DOCS, ws: Workspace | None = None) -> QualityModel:
    """Labeller accuracies from the votes on all of ``docs``; the scorer from 1.3 * ``train_docs`` distinct texts, or all if there are fewer.

    Those are the texts whose hashes are least, each once however often it is repeated: copies take no place from others,
    and the order of partitions does not matter.  Of a table without texts comes a model that keeps every text that has words.
    """
    own = ws or Workspace(docs.sparkSession, "quality")
    docs = docs.select("text", F.xxhash64("text").alias("rank")).filter("text is not null")
    texts = int(1.3 * train_docs) + 1
    votes = own.save(docs.mapInArrow(_votes(texts), "pattern long, n long, rank long"), "votes")
    counts = votes.filter("pattern is not null").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # at most 2 ** 7 rows
    if not counts:
        return QualityModel(np.zeros(SLOTS), 1.0, {}, {})
    patterns, n = np.array([r.pattern for r in counts]), np.array([r.n for r in counts], float)
    good, table, _ = posterior(patterns, n)
    known = dict(zip(patterns.tolist(), good.tolist(), strict=True))
    last = votes.filter("rank is not null").select("rank").distinct().orderBy("rank").limit(texts).agg(F.max("rank").alias("rank")).first().rank
    own.drop("votes")
    picked = docs.filter(F.col("rank") <= last).groupBy("rank").agg(F.min("text").alias("text")).orderBy("rank")
    rows = picked.mapInArrow(_training, "pattern long, slot binary, value binary").collect()
    accuracies = {name: (float(table[0, k]), float(1 - table[1, k])) for k, name in enumerate(LABELLERS)}
    if not rows:
        return QualityModel(np.zeros(SLOTS), 1.0, accuracies, known)
    w, b = _linear(rows, np.array([known.get(r.pattern, 0.5) for r in rows]))
    return QualityModel(w, b, accuracies, known)


def score_quality(docs: DataFrame, model: QualityModel | None = None) -> DataFrame:
    """``docs(doc_id, text)`` -> per row doc_id, n_words, posterior (of the labellers), score, keep.

    ``score`` is the linear scorer's log-odds of good text and ``keep`` says that it is not below ``REJECT_BELOW``.  A text
    without words (null, empty, blank) has a null posterior and score and is not kept.  Repeated rows are scored each;
    other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or fit_quality(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            n, post, score = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0)]
            for _, _, w in _blocks(batch):
                n.append(w.n)
                post.append(np.array([model.posterior.get(int(c), 0.5) for c in w.patterns()]))
                score.append(model.score(w))
            n, post, score = np.concatenate(n), np.concatenate(post), np.concatenate(score)
            none = n == 0
            cols = [batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(post, mask=none), pa.array(score, mask=none), pa.array(~none & (score >= REJECT_BELOW))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "posterior", "score", "keep"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_words long, posterior double, score double, keep boolean")


def keep_good(docs: DataFrame, model: QualityModel | None = None) -> DataFrame:
    """The rows of ``docs`` that the scorer does not reject, unchanged.

    Texts without words (null, empty, blank) go; repeated rows stay or go together; an empty table stays empty.
    """
    shared, names = docs.sparkSession.sparkContext.broadcast(model or fit_quality(docs)), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [(w.n > 0) & (shared.value.score(w) >= REJECT_BELOW) for *_, w in _blocks(batch)]
            yield batch.select(names).filter(pa.array(np.concatenate([np.zeros(0, bool), *keep])))

    return docs.mapInArrow(run, docs.schema)
