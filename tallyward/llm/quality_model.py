"""Quality classifier: ordinal cumulative-link regression on hashed text.

P(grade <= k) = sigmoid(threshold_k - score), where the score is a sum of shared
weights of hashed text features and the thresholds are ordered. Documents are
selected by the probability of the top grade.

Features are the distinct words of a text (lower case, without symbols), the
first four and six letters of longer ones, and whether these recur, its marks,
and a coarse profile of it, each hashed into one of 2**HASH_BITS places. Places met in fewer than LEAST training texts have no weight.

The model is fitted on a bounded sample: the SAMPLE rated documents with the
smallest hash of their id. Its places are computed once and packed by the executors into
blocks of arrays, 4 bytes a place. Up to LOCAL places are fitted on the driver, block by block;
more stay in the executors, and every step of the fit is a job that adds up their gradients.
Sums are of rounded terms and so exact: the model does not depend on how the sample is dealt or where it is fitted.
All documents are scored, in one pass and without a shuffle; the model has a fixed size.

Fitting and scoring read a text alike: as its set of places, in each of which it counts once.

Defined cases: a null text counts as empty, has no features and scores 0; a very long text is read whole;
ratings that are null in any column are not used; repeated ratings of one document each count, and of
documents that share an id the one with the least text is rated; repeated rows get equal scores; without ratings of two grades every document has
the same probabilities; an empty table gives an empty result; columns other
than those named are never read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import Tables, require

#: Rated texts for which packing and fitting take one more task, up to the session's parallelism.
BLOCK_TEXTS = 1000
#: Places of a sample that is fitted on the driver: 64 MB. A job for each step costs more than such a step.
LOCAL = 1 << 24
HASH_BITS, SAMPLE, LEAST, STEPS, PENALTY, PROFILE_WEIGHT = 18, 12_000, 8, 300, 1e-3, 4
_LETTERS = re.compile(r"[^\W\d_]+")
_MARKS = re.compile(r"[^\w\s.,;:'\"()-]+")


def text_features(text: str | None) -> set[str]:
    """Distinct words, beginnings of words (and which of these recur), marks, and a coarse profile of the text.

    A profile feature stands in PROFILE_WEIGHT places, so that the penalty weighs less on it than on a word.
    """
    text = text or ""
    words = text.split()
    n = max(1, len(words))
    counts = Counter(_LETTERS.findall(text.lower()))
    begins: Counter = Counter()
    for w, k in counts.items():
        if len(w) > 4:
            begins[w[:4]] += k
            if len(w) > 6:
                begins[w[:6]] += k
    found = set(counts)
    found.update(f"{w}*" for w in begins)
    found.update(f"{w}**" for w, k in begins.items() if k > 1)
    found.update("mark:" + m for m in set(_MARKS.findall(text)))
    tenths = lambda part: min(9, int(10 * part / n))
    lines = [x for x in text.split("\n") if x.strip()]
    profile = (
        f"symbols:{tenths(sum(map(text.count, '#*$%&|<>')))}",
        f"bars:{tenths(sum(w == '|' for w in words))}",
        f"upper:{tenths(sum(w.isupper() for w in words))}",
        f"cries:{tenths(text.count('!'))}",
        f"distinct:{tenths(len(set(words)))}",
        f"windows:{tenths(len(set(zip(words, words[1:], words[2:]))))}",
        f"words:{n.bit_length()}",
        f"lines:{int(10 * len(set(lines)) / max(1, len(lines)))}",
    )
    found.update(f"{p}~{i}" for p in profile for i in range(PROFILE_WEIGHT))
    return found


def place(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << HASH_BITS) - 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass(frozen=True)
class OrdinalModel:
    weights: np.ndarray  # of each hashed place
    thresholds: np.ndarray  # ordered; one fewer than grades

    def probabilities(self, scores: np.ndarray) -> np.ndarray:
        """A row of grade probabilities for each score."""
        upto = _sigmoid(self.thresholds[None, :] - scores[:, None])
        return np.diff(np.concatenate([np.zeros((len(scores), 1)), upto, np.ones((len(scores), 1))], axis=1), axis=1)


Gradient = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Block:
    """Rated texts as arrays: the columns of all texts one after the other, how many each has, its grade and number of ratings."""

    columns: np.ndarray
    lengths: np.ndarray
    grades: np.ndarray
    times: np.ndarray

    def gradient(self, w: np.ndarray, thresholds: np.ndarray, balance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the loss by each weight, and by each edge between grades (the outer two included).

        Terms are multiples of 2**-50 and 2**-40. Those of the weights are at most 1 in sum, so adding them is exact in any order.
        """
        s = np.zeros(len(self.grades))
        if len(self.columns):
            s[self.lengths > 0] = np.add.reduceat(w[self.columns], (np.cumsum(self.lengths) - self.lengths)[self.lengths > 0])
        edges = np.concatenate([[-np.inf], thresholds, [np.inf]])
        high, low = _sigmoid(np.clip(edges[self.grades + 1] - s, -60, 60)), _sigmoid(np.clip(edges[self.grades] - s, -60, 60))
        p = np.maximum(high - low, 1e-9)
        d_high, d_low = high * (1 - high), low * (1 - low)
        share = balance[self.grades]
        d_score = np.round(share * (d_high - d_low) / p * 2.0**50) / 2.0**50 * self.times
        by_edge = np.zeros(len(edges))
        np.add.at(by_edge, self.grades + 1, -np.round(share * d_high / p * 2.0**40) / 2.0**40 * self.times)
        np.add.at(by_edge, self.grades, np.round(share * d_low / p * 2.0**40) / 2.0**40 * self.times)
        return np.bincount(self.columns, np.repeat(d_score, self.lengths), minlength=len(w)), by_edge


def _descend(used: np.ndarray, rated: np.ndarray, gradient: Gradient, steps: int, penalty: float) -> OrdinalModel:
    """Maximum likelihood with an L2 penalty, by Adam on all rows at once; ordered thresholds as a first one and positive gaps.

    ``used`` are the places with a weight, ``rated`` the number of ratings of each grade.
    """
    n_grades, counts = len(rated), rated + 1.0
    upto = np.cumsum(counts)[:-1] / counts.sum()
    start = np.log(upto / (1 - upto))
    w = np.zeros(len(used))
    t = np.concatenate([start[:1], np.log(np.maximum(1e-3, np.diff(start)))])
    balance = np.sqrt(counts.sum() / (n_grades * counts))
    balance = balance / max(1e-9, (rated * balance).sum())
    m = [np.zeros_like(w), np.zeros_like(t)]
    v = [np.zeros_like(w), np.zeros_like(t)]
    for step in range(1, steps + 1 if rated.sum() else 1):
        g_w, by_edge = gradient(w, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])])), balance)
        g_w = g_w + penalty * w
        by_threshold = by_edge[1:n_grades]
        g_t = np.concatenate([[by_threshold.sum()], [by_threshold[k:].sum() * np.exp(t[k]) for k in range(1, len(t))]])
        for x, g, a, b in ((w, g_w, m[0], v[0]), (t, g_t, m[1], v[1])):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            x -= 0.05 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(1 << HASH_BITS)
    weights[used] = w
    return OrdinalModel(weights, np.cumsum(np.concatenate([t[:1], np.exp(t[1:])])))


def _numbers(used: np.ndarray) -> np.ndarray:
    """The column of each place, -1 for places without a weight."""
    number = np.full(1 << HASH_BITS, -1, np.int32)
    number[used] = np.arange(len(used))
    return number


def fit_ordinal(features: list[np.ndarray], grades: np.ndarray, n_grades: int, steps: int = STEPS, penalty: float = PENALTY) -> OrdinalModel:
    """The model of a few rated texts at hand, given by their places."""
    places = np.concatenate(features) if features else np.zeros(0, int)
    used = np.flatnonzero(np.bincount(places, minlength=1 << HASH_BITS) >= LEAST)
    number = _numbers(used)
    index = [number[f][number[f] >= 0] for f in features]
    block = Block(np.concatenate(index) if index else np.zeros(0, int), np.array([len(i) for i in index], int), grades, np.ones(len(grades), int))
    return _descend(used, np.bincount(grades, minlength=n_grades), block.gradient, steps, penalty)


def fit_places(placed: DataFrame, n_grades: int, steps: int = STEPS, penalty: float = PENALTY) -> OrdinalModel:
    """The model of the rated texts of ``place_sample``, of which at most LOCAL places come to the driver."""
    spark = placed.sparkSession
    rated = np.zeros(n_grades, int)
    n = size = 0
    for grade, ratings, texts, places in placed.groupBy("grade").agg(F.sum("times"), F.count("*"), F.sum(F.size("places"))).collect():
        rated[grade] = ratings
        n += texts
        size += places
    held = placed.select(F.explode("places").alias("place"), "times").groupBy("place").agg(F.sum("times").alias("held"))
    used = np.sort(held.where(F.col("held") >= LEAST).select("place").toPandas()["place"].to_numpy(np.int64))  # at most 2**HASH_BITS
    shared = spark.sparkContext.broadcast(_numbers(used))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, BLOCK_TEXTS) for b in batches for i in range(0, len(b), BLOCK_TEXTS)):
            columns = shared.value[batch.column("places").flatten().to_numpy()]
            rows = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column("places")).to_numpy())
            lengths = np.bincount(rows[columns >= 0], minlength=len(batch))
            arrays = (columns[columns >= 0], lengths, batch.column("grade").to_numpy(), batch.column("times").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([a.astype(np.int32).tobytes()], pa.binary()) for a in arrays], names=["columns", "lengths", "grades", "times"])

    tasks = max(1, min(spark.sparkContext.defaultParallelism, -(-n // BLOCK_TEXTS)))
    packed = placed.select("grade", "times", "places").coalesce(tasks).mapInArrow(pack, "columns binary, lengths binary, grades binary, times binary")

    def add(rows: Iterable, w: np.ndarray, thresholds: np.ndarray, balance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        by_weight, by_edge = np.zeros(len(w)), np.zeros(len(thresholds) + 2)
        for row in rows:
            a, b = Block(*(np.frombuffer(x, np.int32) for x in row)).gradient(w, thresholds, balance)
            by_weight += a
            by_edge += b
        return by_weight, by_edge

    if size <= LOCAL:
        rows = list(packed.toLocalIterator())
        return _descend(used, rated, lambda *at: add(rows, *at), steps, penalty)
    blocks = packed.rdd.persist(StorageLevel.MEMORY_AND_DISK)

    def gradient(*at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = blocks.mapPartitions(lambda rows: [add(rows, *at)]).collect()
        return sum(a for a, _ in parts), sum(b for _, b in parts)

    try:
        return _descend(used, rated, gradient, steps, penalty)
    finally:
        blocks.unpersist()


def text_places(text: str | None, known: dict[str, int] | None = None) -> list[int]:
    """The distinct places of a text's features, in order; none for an empty text. What is fitted and what is scored."""
    if not text:
        return []
    known = {} if known is None else known
    if len(known) > 200_000:
        known.clear()
    found = set()
    for f in text_features(text):
        at = known.get(f)
        if at is None:
            at = known[f] = place(f)
        found.add(at)
    return sorted(found)


def place_sample(docs: DataFrame, ratings: DataFrame, grade: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """doc_id, grade, times (equal ratings) and places of the rated documents with the smallest hash of their id, at most ``sample`` ratings."""
    rated = ratings.select(F.col(id_col).alias("doc_id"), grade.cast("int").alias("grade")).dropna()
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    chosen = chosen.groupBy("doc_id", "grade").agg(F.count("*").cast("int").alias("times"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # At most ``sample`` rows of numbers are broadcast, and one text of each id is kept, so no more texts are read than that.
    joined = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "grade", "times").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            placed = [text_places(t.as_py(), known) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("grade"), batch.column("times"), pa.array(placed, pa.list_(pa.int32()))], names=["doc_id", "grade", "times", "places"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", "grade", "times", "text").mapInArrow(run, f"doc_id {kind}, grade int, times int, places array<int>")


def training_sample(docs: DataFrame, ratings: DataFrame, grade: Column, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> tuple[list[np.ndarray], np.ndarray, list]:
    """A small sample brought to the driver, for ``fit_ordinal``: features, grades and ids, once for each rating."""
    rows = place_sample(docs, ratings, grade, id_col, text_col, sample).toPandas()
    rows = rows.sort_values(["doc_id", "grade"], kind="stable")
    rows = rows.loc[rows.index.repeat(rows["times"])]
    return [np.asarray(p, np.int64) for p in rows["places"]], rows["grade"].to_numpy(np.int64), rows["doc_id"].tolist()


def score_documents(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """doc_id, score, grade probabilities, expected_grade, tail_probability (of the top grade) and kept."""
    require(docs, id_col, text_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known: dict[str, int] = {}
        for batch in batches:
            # The exact sum, whatever the order.
            scores = [math.fsum(model.weights[text_places(t.as_py(), known)].tolist()) for t in batch.column(1)]
            scores = np.array(scores)
            p = model.probabilities(scores)
            tail = p[:, -1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array(list(p), pa.list_(pa.float64())), pa.array(p @ np.arange(p.shape[1]), pa.float64()), pa.array(tail, pa.float64()), pa.array(tail >= least)],
                names=["doc_id", "score", "probabilities", "expected_grade", "tail_probability", "kept"],
            )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, score double, probabilities array<double>, expected_grade double, tail_probability double, kept boolean")


def label_grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Three grades from two flags: 0 toxic, 1 poor, 2 good."""
    return F.when(F.col(toxic) > 0, 0).when(F.col(quality) <= 0, 1).when((F.col(quality) > 0) & (F.col(toxic) <= 0), 2)


def classify(docs: DataFrame, ratings: DataFrame, grade: Column | None = None, n_grades: int = 3, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """Fit on rated documents and score all documents."""
    require(docs, "doc_id", "text")
    tables = Tables(docs.sparkSession, "ratings")
    placed = tables.put(place_sample(docs, ratings, label_grade() if grade is None else grade, sample=sample))
    model = fit_places(placed, n_grades)
    tables.drop()
    return score_documents(docs, model, least=least)
