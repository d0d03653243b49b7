"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A document's grade is 0 (low quality), 1 (good text with toxic words) or 2 (good). One weight vector over hashed text
features gives a score; ordered thresholds cut the line of scores into grades: P(grade <= k) = sigmoid(threshold_k - score).
The expected grade and the tail probabilities follow, and a document is kept if P(grade = 2) is at least ``keep_from``

Features are 64-bit hashes, so different features do not fall together: every distinct word, its first letters (for
words that come with many endings), and the shapes of the words
(runs of lower-case, capital, digit, other) with their share of the text in powers of two, the share of distinct words, and
the share of distinct lines. A feature counts once in a document, so the value does not depend on the length.

The fit is Fisher scoring with a ridge penalty. It takes ``most_rows`` labelled documents at most, those with the smallest hash of their id, and features that at least
``least_docs`` of them have. The model that goes to the executors has at most ``most_weights`` weights. Every document is scored on its whole text.

Defined cases
- A null or empty text has the feature of empty texts only and is scored by it.
- Labels with a null field or id are left out; of several for one id the lowest grade holds.
- With one grade only among the labelled documents every document gets that grade; without any, the highest.
- Rows keep their ``doc_id``, null or repeated; other columns are passed through by ``keep_good``.
"""

from __future__ import annotations

import math
import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import column, slices

MOST_ROWS = 6000
LEAST_DOCS = 4
MOST_WEIGHTS = 600
LEAST_Z = 5.0
REMEMBERED = 60_000
STEMS = (4, 5)
LETTERS = bytes(
    ord("a") if 0x61 <= b <= 0x7A or b >= 0x80 else ord("A") if 0x41 <= b <= 0x5A else ord("0") if 0x30 <= b <= 0x39 else ord("."
    ) if b in b".,;:" else b
    for b in range(256)
)


class Features:
    """Distinct feature hashes of texts; remembers the words it has met."""

    def __init__(self):
        self.known: dict[bytes, tuple[tuple[int, ...], bytes]] = {}

    def word(self, word: bytes) -> tuple[tuple[int, ...], bytes]:
        """Hashes of a word's letters and of its first letters, and its shape."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            bare = word.lower().strip(b".,;:!?\"'()[]{}|#$%&*<>-_")
            shape = word.translate(LETTERS)
            short = shape[:1] + b"".join(shape[i : i + 1] for i in range(1, len(shape)) if shape[i] != shape[i - 1])
            found = self.known[word] = (
                tuple(xxhash.xxh3_64_intdigest(part) for part in {bare, *(b"\0%d" % k + bare[:k] for k in STEMS if len(bare) >= k)}),
                short[:12],
            )
        return found

    def of(self, text: str | None) -> np.ndarray:
        data = (text or "").encode("utf-8", "surrogatepass")
        words = data.split()
        if not words:
            return np.array([xxhash.xxh3_64_intdigest(b"\0empty")], np.uint64)
        hashes, shapes = set(), Counter()
        for word, many in Counter(words).items():
            h, shape = self.word(word)
            hashes.update(h)
            shapes[shape] += many
        notes = [b"\0shape %s %d" % (s, math.log2(len(words) / n)) for s, n in shapes.items()]
        lines = data.split(b"\n")
        repeated = 1 - sum(map(operator.eq, words, words[1:])) / len(words)
        for name, share in ((b"words", len(set(words)) / len(words)), (b"lines", len(set(lines)) / len(lines)), (b"steps", repeated)):
            # one more feature for each step down, so that less is never better for the model than more
            notes += [b"\0%s %d" % (name, i) for i in range(min(12, int(-2 * math.log2(share))))]
        notes.append(b"\0size %d" % len(words).bit_length())
        hashes.update(map(xxhash.xxh3_64_intdigest, notes))
        return np.fromiter(hashes, np.uint64, len(hashes))


@dataclass
class Model:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def score(self, hashes: np.ndarray) -> float:
        if not len(self.features):
            return 0.0
        at = np.minimum(np.searchsorted(self.features, hashes), len(self.features) - 1)
        return float(self.weights[at[self.features[at] == hashes]].sum())

    def tails(self, score: float) -> list[float]:
        """P(grade >= k) for k from 1 on."""
        return [1 / (1 + math.exp(min(700.0, t - score))) for t in self.thresholds]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def scoring(x: np.ndarray, grades: np.ndarray, ridge: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Ordered thresholds and weights by Fisher scoring on the likelihood of the grades with a ridge penalty."""
    share = np.array([np.clip((grades >= k).mean(), 1e-3, 1 - 1e-3) for k in (1, 2)])
    theta, w = np.log(1 / share - 1) + np.array([0, 1e-3]), np.zeros(x.shape[1])

    def chances(theta: np.ndarray, w: np.ndarray):
        s = x @ w
        f1, f2 = sigmoid(theta[0] - s), sigmoid(theta[1] - s)
        p = np.maximum(np.stack([f1, f2 - f1, 1 - f2]), 1e-9)
        return f1 * (1 - f1), f2 * (1 - f2), p, -np.log(p[grades, np.arange(len(s))]).sum() + ridge / 2 * (w @ w)

    g1, g2, p, loss = chances(theta, w)
    for _ in range(rounds):
        # derivatives of the three chances by the two thresholds and by the score, one row for each
        by = np.stack([[g1, -g1, 0 * g1], [0 * g2, g2, -g2], [-g1, g1 - g2, g2]])
        slope = by[:, grades, np.arange(len(grades))] / p[grades, np.arange(len(grades))]
        info = np.einsum("akn,bkn->abn", by, by / p)
        gradient = np.concatenate([slope[:2].sum(axis=1), x.T @ slope[2] - ridge * w])
        cross = info[:2, 2] @ x
        hessian = np.block([[info[:2, :2].sum(axis=2), cross], [cross.T, x.T @ (x * info[2, 2][:, None])]])
        hessian[np.diag_indices_from(hessian)] += np.concatenate([[1e-6, 1e-6], np.full(len(w), ridge)])
        move, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-3:
            t, v = theta + size * move[:2], w + size * move[2:]
            if t[1] > t[0] and (new := chances(t, v))[3] < loss:
                break
            size /= 2
        else:
            break
        done = loss - new[3] < 1e-6 * loss
        theta, w, (g1, g2, p, loss) = t, v, new
        if done:
            break
    return theta, w


def telling(row: np.ndarray, at: np.ndarray, grades: np.ndarray, features: int, least_docs: int, least_z: float) -> np.ndarray:
    """How far each feature's share differs between the grades below and above a cut, in standard errors, at its best cut."""
    many, best = np.bincount(at, minlength=features), np.zeros(features)
    for cut in (1, 2):
        above = grades >= cut
        n, n_above = len(grades), int(above.sum())
        if 0 < n_above < n:
            have = np.bincount(at, above[row], features)
            share = many / n
            gap = have / n_above - (many - have) / (n - n_above)
            spread = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n_above + 1 / (n - n_above)))
            best = np.maximum(best, np.abs(gap) / spread)
    return np.where((many >= least_docs) & (best >= least_z), best, 0)


def fit(rows: list[np.ndarray], grades: np.ndarray, least_docs: int = LEAST_DOCS, most_weights: int = MOST_WEIGHTS,
        least_z: float = LEAST_Z, ridge: float = 0.3, rounds: int = 40) -> Model:
    """Weights and ordered thresholds by the likelihood of the grades, over the features that tell."""
    if len(set(grades.tolist())) < 2:
        top = int(grades[0]) if len(grades) else 2
        return Model(np.empty(0, np.uint64), np.empty(0), np.array([-50.0 if k <= top else 50.0 for k in (1, 2)]))
    names, at = np.unique(np.concatenate(rows), return_inverse=True)
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    z = telling(row, at, grades, len(names), least_docs, least_z)
    keep = np.zeros(len(names), bool)
    keep[np.argsort(-z, kind="stable")[:most_weights]] = True
    keep &= z > 0
    used = keep[at]
    x = np.zeros((len(rows), int(keep.sum())))
    x[row[used], (np.cumsum(keep) - 1)[at][used]] = 1
    thresholds, weights = scoring(x, grades, ridge, rounds)
    return Model(names[keep], weights, thresholds)


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in slices(batches):
        rows = [features.of(t).view(np.int64) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows, pa.list_(pa.int64()))], ["grade", "features"]
        )


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", most_rows: int = MOST_ROWS, **settings) -> Model:
    """Fits on the labelled documents. labels: ``doc_id, quality, toxic``."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    graded = labels.filter("doc_id is not null and quality is not null and toxic is not null").groupBy(
        F.col("doc_id").cast("long").alias("_id")
    ).agg(F.min(grade).alias("grade"))
    # the rows to fit on are chosen by id, before any text is read
    present = docs.select(column(doc_id).cast("long").alias("_id")).distinct().join(graded, "_id")
    chosen = present.orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    texts = docs.select(column(doc_id).cast("long").alias("_id"), column(text).alias("text"))
    taken = texts.join(F.broadcast(chosen), "_id").dropDuplicates(["_id"]).select("grade", "text")  # most_rows at most
    rows = taken.mapInArrow(hashed, "grade int, features array<long>").toArrow()
    lists = rows.column("features").combine_chunks()
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    features = [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    return fit(features, rows.column("grade").to_numpy().astype(np.int64), **settings)


def scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slices(batches):
            tails = [model.tails(model.score(features.of(t))) for t in batch.column(1).to_pylist()]
            p1, p2 = (pa.array([t[i] for t in tails], pa.float64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([sum(t) for t in tails], pa.float64()), p1, p2], ["doc_id", "expected_grade", "p_not_low", "p_good"]
            )

    return run


def grade_documents(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", keep_from: float = 0.75) -> DataFrame:
    """``doc_id, expected_grade, p_not_low, p_good, kept`` of every row."""
    docs = docs.select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    graded = docs.mapInArrow(scorer(model), "doc_id long, expected_grade double, p_not_low double, p_good double")
    return graded.withColumn("kept", F.col("p_good") >= keep_from)


def good(model: Model, place: int, keep_from: float):
    """Rows whose text, at ``place``, is good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in slices(batches):
            keep = [model.tails(model.score(features.of(t)))[1] >= keep_from for t in batch.column(place).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def keep_good(docs: DataFrame, model: Model, text: str = "text", keep_from: float = 0.75) -> DataFrame:
    """The rows of ``docs``, with all their columns, that are good with a probability of ``keep_from`` or more."""
    # under plain names: a column's own may hold dots
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(good(model, docs.columns.index(text), keep_from), plain.schema).toDF(*docs.columns)
