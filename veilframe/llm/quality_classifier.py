"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's score s is a sum of weights of hashed text features, shared by all grades; ordered
thresholds t1 < t2 < ... turn it into P(grade >= k) = sigmoid(s - tk). Their sum is the
expected grade, the last (or any chosen) one the tail probability for selection.

Features, each present or not: words (ASCII letters lower-cased, punctuation trimmed) and
bands of the text's form (share of capitals and digits, symbols a word, share of repeated
words, mean word length, number of words). They are hashed into ``2 ** BITS`` places.

Fitting takes at most ``MAX_ROWS`` rated rows, those with the least hash of their id, so that
the choice depends neither on partitions nor on the corpus' size; everything else, scoring
included, covers all rows. Places are screened by their association with the grades, then
weights and thresholds descend the likelihood together. The model is a vector of fixed size.

Defined cases: null and empty texts have only the feature of their form and are scored; rated
rows without a text, or with a null grade, are left out of fitting; several ratings of one id
count one each; fitting needs two different grades and raises otherwise; repeated rows get
equal scores; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.shipping import keep, map_batches

BITS = 18
#: Bound of the sample for fitting.
MAX_ROWS = 12_000
#: A place is used if it is in so many rated texts and its z-score at a threshold is so high.
MIN_TEXTS, MIN_Z = 8, 4.0
STEPS, RATE, RIDGE = 400, 0.05, 1e-3
#: Words remembered with their places by a worker.
MAX_WORDS = 200_000


class _Places(dict):
    def __missing__(self, word: bytes) -> int:
        place = xxhash.xxh64_intdigest(word.strip(b".,;:!?\"'()[]#*$%&|") or b"\x00symbols") >> (64 - BITS)
        if len(self) >= MAX_WORDS:
            self.clear()
        self[word] = place
        return place


def _form(data: bytes, n_words: int, distinct: int) -> list[bytes]:
    if not n_words:
        return [b"\x00empty"]
    count = lambda of: len(data) - len(data.translate(None, of))
    bands = {
        b"capitals": count(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / len(data),
        b"digits": count(b"0123456789") / len(data),
        b"symbols": count(b"#*$%&|<>!") / n_words,
        b"repeated": 1 - distinct / n_words,
        b"length": len(data) / n_words / 20,
    }
    return [b"\x00%s=%d" % (k, min(9, int(10 * v))) for k, v in bands.items()] + [b"\x00words=%d" % n_words.bit_length()]


def features(text: str | None) -> np.ndarray:
    """Sorted distinct places of a text's features."""
    data = (text or "").encode()
    words = data.lower().split()
    distinct = set(words)
    form = [xxhash.xxh64_intdigest(f) >> (64 - BITS) for f in _form(data, len(words), len(distinct))]
    places = keep(__name__, "places", _Places)
    return np.array(sorted({*map(places.__getitem__, distinct), *form}), np.int64)


@dataclass(frozen=True)
class Model:
    """Weights by place and ordered thresholds; grades are 0 .. len(thresholds)."""

    weights: np.ndarray
    thresholds: np.ndarray

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k), a column for each k from 1."""
        return _sigmoid(np.asarray(score)[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _screen(place: np.ndarray, row: np.ndarray, grade: np.ndarray, n_grades: int) -> np.ndarray:
    """Places whose presence goes with the grade at some threshold."""
    size, n = 1 << BITS, len(grade)
    there = np.bincount(place, minlength=size).astype(float)
    best = np.zeros(size)
    for k in range(1, n_grades):
        top = grade >= k
        share = top.mean()
        seen = np.bincount(place, weights=top[row], minlength=size)
        spread = np.sqrt(np.maximum(there * share * (1 - share) * (1 - there / n), 1e-9))
        best = np.maximum(best, np.abs(seen - there * share) / spread)
    return np.flatnonzero((best >= MIN_Z) & (there >= MIN_TEXTS) & (there < n))


def fit_rows(rows: list[np.ndarray], grade: np.ndarray) -> Model:
    """Maximum likelihood with a small ridge, by Adam on the whole (bounded) sample."""
    n_grades = int(grade.max(initial=0)) + 1
    if len(np.unique(grade)) < 2:
        raise ValueError("fitting needs rated rows of at least two grades")
    place, row = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    used = _screen(place, row, grade, n_grades)
    slot = np.full(1 << BITS, -1)
    slot[used] = np.arange(len(used))
    keep = slot[place] >= 0
    place, row = slot[place[keep]], row[keep]
    first = np.array([np.log((grade < k).mean() + 1e-3) - np.log((grade >= k).mean() + 1e-3) for k in range(1, n_grades)])
    gaps = np.log(np.maximum(np.diff(first), 0.1))
    values = np.concatenate([np.zeros(len(used)), first[:1], gaps])  # thresholds stay ordered: first, then logs of gaps
    speed, drift, n = np.zeros_like(values), np.zeros_like(values), len(grade)
    for step in range(1, STEPS + 1):
        weights, low, gap = values[: len(used)], values[len(used)], np.exp(values[len(used) + 1 :])
        thresholds = low + np.concatenate([[0.0], np.cumsum(gap)])
        score = np.bincount(row, weights=weights[place], minlength=n)
        above = np.concatenate([np.ones((n, 1)), _sigmoid(score[:, None] - thresholds), np.zeros((n, 1))], axis=1)
        here, there = above[np.arange(n), grade], above[np.arange(n), grade + 1]
        probable = np.maximum(here - there, 1e-9)
        d_here, d_there = here * (1 - here) / probable, there * (1 - there) / probable
        by_score = d_here - d_there
        by_threshold = np.array([d_there[grade == k - 1].sum() - d_here[grade == k].sum() for k in range(1, n_grades)])
        slope = np.concatenate([
            np.bincount(place, weights=by_score[row], minlength=len(used)) - RIDGE * n * weights,
            [by_threshold.sum()], [by_threshold[j:].sum() * gap[j - 1] for j in range(1, n_grades - 1)]]) / n
        drift, speed = 0.9 * drift + 0.1 * slope, 0.999 * speed + 0.001 * slope**2
        values = values + RATE * (drift / (1 - 0.9**step)) / (np.sqrt(speed / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << BITS)
    weights[used] = values[: len(used)]
    return Model(weights, values[len(used)] + np.concatenate([[0.0], np.cumsum(np.exp(values[len(used) + 1 :]))]))


def fit(df: DataFrame, ratings: DataFrame, grade: Column | str = "grade", max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """A model from at most ``max_rows`` ratings (``id_col`` and ``grade``: 0, 1, ...) of the texts of ``df``."""
    grade = F.col(grade) if isinstance(grade, str) else grade
    rated = ratings.select(F.col(f"`{id_col}`").alias("id"), grade.cast("int").alias("grade")).dropna()
    sample = F.broadcast(rated.orderBy(F.xxhash64("id"), "grade").limit(max_rows))  # at most max_rows rows of 16 bytes
    texts = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter(F.col("text").isNotNull())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [features(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["grade", "places"])

    rows = map_batches(texts.join(sample, "id").select("grade", "text"), run, "grade int, places array<int>").toArrow()
    grades, places = rows.column("grade").to_numpy(), rows.column("places").combine_chunks()  # flat arrays: lists of numbers would take ten times their bytes
    ends, flat = places.offsets.to_numpy(), places.values.to_numpy()
    each = [flat[a:b] for a, b in zip(ends, ends[1:])]
    order = sorted(range(len(each)), key=lambda k: (grades[k], each[k].astype(">i4").tobytes()))  # whatever order the partitions came in
    return fit_rows([each[k] for k in order], grades[order].astype(np.int64))


def score(df: DataFrame, model: Model, tail: int | None = None, text_col: str = "text") -> DataFrame:
    """``df`` with ``expected_grade`` and ``tail_probability``, P(grade >= ``tail``), by default of the top grade; both replace columns of these names."""
    tail = len(model.thresholds) if tail is None else tail
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS doubles, whatever the input
    picked = df.drop("expected_grade", "tail_probability")
    names, at = picked.columns, picked.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        weights = shared.value.weights
        above = shared.value.at_least(np.array([weights[features(t)].sum() for t in batch.column(at).to_pylist()], float))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(above.sum(1)), pa.array(np.ascontiguousarray(above[:, tail - 1]))], names=[*names, "expected_grade", "tail_probability"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema)
    return map_batches(picked, run, schema + ", expected_grade double, tail_probability double", text_at=at)
