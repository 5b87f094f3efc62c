"""Near-duplicates by one-permutation MinHash.

A document is the set of its distinct word shingles, as 64-bit hashes. One pass
puts the hashes into BINS bins and keeps the least of each; empty bins borrow
from others by optimal densification. BANDS bands of ROWS bins make the buckets.
At a similarity of 0.8 a pair shares no bucket with probability (1 - 0.8**6)**48,
about 5e-7.

Equal sets are collapsed first, so copies cost one row each. Members of a bucket
are tied to its least member only (star-shaped candidate edges); the components
of these edges are clusters of candidates. Links are then confirmed on full sets
within each cluster: a document is compared with those not yet linked to it,
until the cluster is one component or every pair is settled. Clusters whose sets
exceed CLUSTER_SHINGLES are not gathered; there, rounds of stars with ever more
centres to a bucket do the same, until no bucket has an unsettled pair.

Defined cases: null and empty texts and those without words have the empty set,
are linked with nothing and form a component each; a text with fewer words than a
shingle has its whole word sequence as one shingle; repeated rows and equal texts
are one component; in `near_duplicates` rows that share an id are one document and rows with a null id are components of their own
(component_id null), in `drop_near_duplicates` each row is a document, whatever its id; very long texts are read whole, a set
being at most as large as its text; a tie of ids goes to the row that is read first; an empty table gives an empty result; columns other than
those named are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import Tables, require, settle
from tallyward.llm.components import connected

BANDS, ROWS = 48, 6
BINS = BANDS * ROWS
#: Distinct shingles of a cluster, all members together, that one task compares in memory; each member counts as
#: MEMBER_COST more, as comparisons grow with their number.
CLUSTER_SHINGLES, MEMBER_COST = 4_000_000, 400
#: Ids of this many rows are broadcast to pick out texts; beyond it both sides are shuffled.
BROADCAST_ROWS = 1_000_000
_PIECE = 1 << 20
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: multiply and shift."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _numbers(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random odd numbers."""
    return _mix((np.arange(n, dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15) + _U(seed)) | _U(1)


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: bytes, fold: bool = True) -> np.ndarray:
    """A hash of every word of a UTF-8 text, with A-Z in lower case; a piece of the text at a time."""
    out, at = [], 0
    while at < len(data):
        stop = min(len(data), at + _PIECE)
        while stop < len(data) and not _SPACE[data[stop]]:
            stop += 1
        raw = np.frombuffer(data, np.uint8, stop - at, at)
        at = stop
        solid = ~_SPACE[raw]
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        kept = (_FOLD[raw] if fold else raw)[solid]
        if not len(kept):
            continue
        starts = np.flatnonzero(first[solid])
        lengths = np.diff(np.append(starts, len(kept)))
        place = np.arange(len(kept)) - np.repeat(starts, lengths)
        weights = _numbers(int(lengths.max()), 11)
        sums = np.add.reduceat((kept.astype(_U) + _U(1)) * weights[place], starts)
        out.append(_mix(sums + lengths.astype(_U) * _U(0xD6E8FEB86659FD93)))
    return np.concatenate(out) if out else np.zeros(0, _U)


def shingles(data: bytes, size: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = word_hashes(data)
    n = len(words)
    if n == 0:
        return words
    if n < size:
        return _mix((words * _numbers(n, 23)).sum(keepdims=True, dtype=_U) + _U(n))
    factors = _numbers(size, 37)
    sums = words[: n - size + 1] * factors[0]
    for i in range(1, size):
        sums = sums + words[i : n - size + 1 + i] * factors[i]
    return np.unique(_mix(sums))


_PROBES: list[np.ndarray] = []


def _probe(k: int) -> np.ndarray:
    while len(_PROBES) <= k:
        bins = np.arange(BINS, dtype=_U) * _U(0x100000001B3) + _numbers(len(_PROBES) + 1, 67)[-1:]
        _PROBES.append((_mix(bins) % _U(BINS)).astype(np.int64))
    return _PROBES[k]


def signature(found: np.ndarray) -> np.ndarray:
    """The least hash of each bin of a sorted, non-empty set; empty bins take that of the first filled bin of their probes."""
    bins = (((found >> _U(32)) * _U(BINS)) >> _U(32)).astype(np.int64)
    first = np.ones(len(bins), bool)
    first[1:] = bins[1:] != bins[:-1]
    out = np.zeros(BINS, _U)
    filled = np.zeros(BINS, bool)
    out[bins[first]] = found[first]
    filled[bins[first]] = True
    empty = np.flatnonzero(~filled)
    k = 0
    while len(empty):
        source = _probe(k)[empty]
        hit = filled[source]
        out[empty[hit]] = out[source[hit]]
        empty = empty[~hit]
        k += 1
    return out


_ROW_FACTORS, _BAND_SEEDS = _numbers(ROWS, 41), _numbers(BANDS, 53)


def buckets(found: np.ndarray) -> np.ndarray:
    """A bucket number for each band."""
    rows = signature(found).reshape(BANDS, ROWS) * _ROW_FACTORS
    return _mix(rows.sum(axis=1, dtype=_U) + _BAND_SEEDS).view(np.int64)


def _bytes(batch: pa.RecordBatch, column: int) -> Iterator[bytes]:
    for value in batch.column(column).cast(pa.binary()):
        yield value.as_py() or b""


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, n_shingles, key1, key2, buckets): the keys are equal for equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, keys1, keys2, bands = [], [], [], []
            for data in _bytes(batch, 1):
                found = shingles(data, size)
                counts.append(len(found))
                keys1.append(int(_mix(found ^ _U(0xA5A5A5A5A5A5A5A5)).sum(dtype=_U).view(np.int64)))
                keys2.append(int(_mix(found * _U(0x9E3779B97F4A7C15)).sum(dtype=_U).view(np.int64)))
                bands.append(buckets(found) if len(found) else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(keys1, pa.int64()), pa.array(keys2, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "key1", "key2", "buckets"],
            )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, key1 long, key2 long, buckets array<long>")


def linked(inter: np.ndarray, a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def link_cluster(sets: list[np.ndarray], percent: int) -> list[int]:
    """The component of each set, by the position of its first member; every pair not joined otherwise is compared."""
    n = len(sets)
    lengths = np.array([len(s) for s in sets])
    values, columns = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(lengths)])
    component = np.arange(n)
    mark = np.zeros(len(values), np.int32)
    waiting = list(range(n - 1, -1, -1))
    settled = np.zeros(n, bool)
    while waiting:
        i = waiting.pop()
        if settled[i]:
            continue
        settled[i] = True
        others = np.flatnonzero((component != component[i]) & ~settled)
        others = others[(100 * np.minimum(lengths[others], lengths[i]) >= percent * np.maximum(lengths[others], lengths[i]))]
        if len(others):
            mark[columns[starts[i] : starts[i + 1]]] = 1
            if len(others) * 4 > n:
                inter = np.add.reduceat(mark[columns], starts[:-1])[others]
            else:
                inter = np.array([mark[columns[starts[j] : starts[j + 1]]].sum() for j in others])
            mark[columns[starts[i] : starts[i + 1]]] = 0
            hits = others[linked(inter, lengths[i], lengths[others], percent)]
            for j in hits:
                component[component == component[j]] = component[i]
            waiting.extend(hits.tolist())  # next those just reached: they see what this one does not
        if (component == component[0]).all():
            break
    first: dict[int, int] = {}
    return [first.setdefault(int(c), i) for i, c in enumerate(component)]


def _link_small(texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(rep, component) of clusters that fit into a task; texts has (cluster, rep, text), each cluster in one partition and in a row."""

    def flush(cluster: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        cluster.sort()
        own = link_cluster([shingles(data, size) for _, data in cluster], percent)
        yield pa.RecordBatch.from_arrays(
            [pa.array([rep for rep, _ in cluster], pa.int64()), pa.array([cluster[c][0] for c in own], pa.int64())], names=["rep", "component"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        current = None
        for batch in batches:
            for c, rep, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _bytes(batch, 2)):
                if c != current and held:
                    yield from flush(held)
                    held = []
                current = c
                held.append((rep, data))
        if held:
            yield from flush(held)

    return texts.mapInArrow(run, "rep long, component long")


def _link_large(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(rep, component) of clusters of any size.

    members has (rep, n, bucket), sets has (rep, shingles). A member that has been
    a centre of a bucket is settled there. A round takes centres from every bucket
    whose unsettled members lie in several components; their number doubles, so
    rounds grow with the logarithm of a bucket.
    """
    tables = Tables(members.sparkSession, "stars")
    live = tables.put(members.select("rep", "n", "bucket"))
    parts = tables.put(live.select("rep", F.col("rep").alias("component")).distinct())
    links = None
    centres = 1
    while True:
        own = live.join(parts, "rep")
        open_ = own.groupBy("bucket").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a <> b").select("bucket")
        own = tables.put(own.join(open_, "bucket"))
        if not own.take(1):
            tables.drop(parts)
            return parts
        salt = F.pmod(F.xxhash64("rep", "bucket"), F.lit(centres))
        stars = tables.put(own.groupBy("bucket", salt.alias("salt")).agg(F.min(F.struct("rep", "n", "component")).alias("c")).select("bucket", "c.*"))
        stars = stars.toDF("bucket", "centre", "m", "other")
        pairs = own.join(stars, "bucket").filter((F.col("component") != F.col("other")) & (F.col("rep") != F.col("centre")))
        pairs = pairs.filter(100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
        pairs = pairs.select(F.least("rep", "centre").alias("x"), F.greatest("rep", "centre").alias("y")).distinct()
        left, right = sets.toDF("x", "xs"), sets.toDF("y", "ys")
        common = F.size(F.array_intersect("xs", "ys"))
        close = pairs.join(left, "x").join(right, "y").filter(100 * common >= percent * (F.size("xs") + F.size("ys") - common)).select("x", "y")
        links = tables.put(close if links is None else links.unionByName(close))
        roots = connected(links, "x", "y")
        parts = tables.put(parts.select("rep").join(roots, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("root", "rep").alias("component")))
        live = tables.put(live.join(stars.select("bucket", F.col("centre").alias("rep")), ["bucket", "rep"], "left_anti"))
        centres *= 2


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, cluster_shingles: int = CLUSTER_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, component_id (the least id reached over links) and kept (it is that one) of every document."""
    require(docs, id_col, text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = settle(signatures(texts, size))
    # Equal sets become one row, under the least id.
    key = ["n_shingles", "key1", "key2"]
    reps = signed.filter("n_shingles > 0 and doc_id is not null").groupBy(*key).agg(F.min("doc_id").alias("rep"), F.min_by("buckets", "doc_id").alias("buckets"))
    reps = settle(reps)
    spread = reps.select("rep", F.col("n_shingles").alias("n"), F.explode("buckets").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min("rep").alias("centre"), F.max("rep").alias("other")).filter("centre <> other")
    shared = settle(shared.select("bucket", "centre"))  # so that a large bucket can be split in the join
    edges = spread.join(shared, "bucket").filter("rep <> centre").select("rep", "centre").distinct()
    clusters = connected(edges, "rep", "centre").toDF("rep", "cluster")
    members = settle(clusters.join(reps.select("rep", F.col("n_shingles").alias("n")), "rep"))
    weights = settle(members.groupBy("cluster").agg(F.sum(F.col("n") + MEMBER_COST).alias("weight")))
    small = members.join(weights.filter(F.col("weight") <= cluster_shingles), "cluster").select("rep", "cluster")
    large = settle(members.join(weights.filter(F.col("weight") > cluster_shingles), "cluster").select("rep", "cluster", "n"))

    def with_text(wanted: DataFrame) -> DataFrame:
        wanted = settle(wanted)
        wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        return texts.join(wanted, texts["doc_id"] == F.col("rep"))

    gathered = with_text(small).select("cluster", "rep", "text").repartition("cluster").sortWithinPartitions("cluster", "rep")
    found = _link_small(gathered, size, percent)
    if large.take(1):
        sets = settle(_sets(with_text(large.select("rep", "cluster")).select("rep", "text"), size))
        spread_large = spread.join(large.select("rep"), "rep")
        found = found.unionByName(_link_large(spread_large, sets, percent))
    found = settle(found.groupBy("rep").agg(F.min("component").alias("component")))
    roots = reps.select(*key, "rep").join(found, "rep", "left").select(*key, F.coalesce("component", "rep").alias("root"))
    joined = signed.select("doc_id", *key).join(roots, key, "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("root")).otherwise(F.col("doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _sets(texts: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(data, size).view(np.int64) for data in _bytes(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["rep", "shingles"])

    return texts.mapInArrow(run, "rep long, shingles array<long>")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with all its columns: that of the least id, null after all others, and of rows that share it the first.

    Rows are told apart by numbers of their own, so rows with one id, or without, are linked by their texts as any
    others are. The numbers are written with the rows, since a second evaluation may deal them otherwise.
    """
    require(docs, id_col, text_col)
    number = "__number"
    while number.lower() in map(str.lower, docs.columns):
        number += "_"
    rows = Tables(docs.sparkSession, "near").put(docs.withColumn(number, F.monotonically_increasing_id()))
    found = near_duplicates(rows, number, text_col, size, percent).select(F.col("doc_id").alias("__row"), "component_id")
    ids = rows.select(F.col(number).alias("__row"), F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(number).alias("row")).alias("place"))
    first = found.join(ids, "__row").groupBy("component_id").agg(F.min("place").alias("place")).select(F.col("place.row").alias("__first"))
    return rows.join(first, F.col(number) == F.col("__first"), "left_semi").drop(number)
