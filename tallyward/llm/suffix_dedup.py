"""Repeated passages: bytes covered by a string of LENGTH bytes that also starts elsewhere.

Suffixes matter up to LENGTH bytes only: in suffix order those that agree so far
stand together, ordered by document and place, and the longest-previous-factor
array exceeds LENGTH where the previous smaller position, the neighbour above,
is in the same run; a match later on is the neighbour below. ``keep="first"``
removes what has an earlier match, ``keep="none"`` what has a match on either side.
``longest_previous_factors`` builds the whole arrays for one text.

No table of all suffixes is made. Strings are looked for by anchors (see
repeats): anchors with a gram that is nowhere else are dropped; where all bytes
of an anchor's strings are the same in several places, one row speaks for the rest; only
what is left, the borders of matches, is brought together by gram and put in
suffix order, with one row for each distinct surrounding. Grams with more than GROUP_ROWS distinct surroundings
are not brought together; there, single strings are, counted where they are first.

Defined cases: a null text has no bytes; texts under LENGTH bytes lose nothing;
rows that repeat an id and a text are copies of each other; with
``keep="first"`` equal rows get the same result, that of the first; documents
are ordered by id, null first; an empty table gives an empty result; columns
other than those named are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm import repeats
from tallyward.llm.common import Tables, require, settle
from tallyward.llm.repeats import LENGTH

#: Distinct surroundings of a gram that one task compares, and rows of a batch of grams, about.
GROUP_ROWS, BATCH_ROWS = 16_384, 4096
#: Anchors that are broadcast to cut out their bytes; beyond it both sides are shuffled.
BROADCAST_ANCHORS = 2_000_000
_U = np.uint64
_NO_ID = -(1 << 63)


def suffix_array(data: bytes) -> np.ndarray:
    """Starts of all suffixes in order, by prefix doubling."""
    rank = np.frombuffer(data, np.uint8).astype(np.int64)
    n, step = len(rank), 1
    while n > 1:
        second = np.zeros(n, np.int64)
        second[: max(0, n - step)] = rank[step:] + 1
        order = np.lexsort((second, rank))
        change = np.concatenate([[0], (rank[order][1:] != rank[order][:-1]) | (second[order][1:] != second[order][:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(change)
        if rank[order[-1]] == n - 1:
            return order
        step *= 2
    return np.arange(n)


def longest_previous_factors(data: bytes) -> np.ndarray:
    """For each place, the length of the longest string from there that also starts earlier.

    Of the suffixes that start earlier, the nearest above and below in suffix order share
    most; a factor is at most one byte shorter than that of the place before.
    """
    order = suffix_array(data)
    n = len(order)
    above, below = np.full(n, -1), np.full(n, -1)
    stack: list[int] = []
    for i in order.tolist():
        while stack and stack[-1] > i:
            below[stack.pop()] = i
        above[i] = stack[-1] if stack else -1
        stack.append(i)

    def common(a: int, b: int, least: int) -> int:
        k = least
        while b + k < n and data[a + k] == data[b + k]:
            k += 1
        return k

    out = np.zeros(n, np.int64)
    for source in (above, below):
        k = 0
        for i in range(n):
            j = int(source[i])
            k = common(j, i, max(0, k - 1)) if j >= 0 and int(source[i - 1] if i else -1) + 1 == j else common(j, i, 0) if j >= 0 else 0
            out[i] = max(out[i], k)
    return out


def covered(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Union of the strings at sorted starts, as (start, end)."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return [(int(a), int(b) + length) for a, b in zip(starts[np.concatenate([[0], cut + 1])], starts[np.append(cut, len(starts) - 1)])]


def later_repeats(data: bytes, length: int = LENGTH) -> list[tuple[int, int]]:
    """The parts of one text that repeat an earlier part of it; the first copy stays."""
    return covered(np.flatnonzero(longest_previous_factors(data) >= length), length)


def string_hashes(bodies: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Hashes of the first ``counts`` strings of LENGTH bytes of each body, one after the other."""
    powers, inverse = repeats._powers()
    out, at = [], 0
    while at < len(bodies):
        stop, size = at, 0
        while stop < len(bodies) and size + len(bodies[stop]) <= repeats._PIECE:
            size += len(bodies[stop])
            stop += 1
        raw = np.frombuffer(b"".join(bodies[at:stop]), np.uint8)
        sums = np.zeros(len(raw) + 1, _U)
        np.cumsum((raw.astype(_U) + _U(1)) * powers[: len(raw)], out=sums[1:])
        lengths = np.array([len(b) for b in bodies[at:stop]])
        offsets = np.cumsum(lengths) - lengths
        n = counts[at:stop]
        starts = np.repeat(offsets - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out.append(repeats._mix((sums[starts + LENGTH] - sums[starts]) * inverse[starts]))
        at = stop
    return np.concatenate(out) if out else np.zeros(0, _U)


def suffix_ranks(bodies: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Place in suffix order, up to LENGTH bytes, of the first ``counts`` strings of each body; equal strings share one.

    By prefix doubling: the order of 8 bytes gives that of 16, and so on; only places with so many bytes
    before the end of their body take part.
    """
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    lengths = counts + LENGTH - 1
    n = len(raw)
    rest = np.repeat(np.cumsum(lengths), lengths) - np.arange(n)
    key = np.zeros(n, _U)
    for i in range(8):
        key[: n - i] = (key[: n - i] << _U(8)) | raw[i:]
    rank = np.zeros(n, np.int64)
    at = np.flatnonzero(rest >= 8)
    rank[at] = np.unique(key[at], return_inverse=True)[1]
    known = 8
    while known < LENGTH:
        shift = min(known, LENGTH - known)
        known += shift
        at = np.flatnonzero(rest >= known)
        rank[at] = np.unique(rank[at] * (n + 1) + rank[at + shift], return_inverse=True)[1]
    return rank[at]


def _anchors(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 256):
                part = batch.slice(i, 256)
                found = [repeats.anchors(t.as_py() or b"") for t in part.column(2).cast(pa.binary())]
                n = np.array([len(f["place"]) for f in found])
                row = np.repeat(np.arange(len(part)), n)
                one = {k: np.concatenate([f[k] for f in found]) for k in found[0]} if found else {}
                if not len(row):
                    continue
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)),
                        pa.array(one["first"], pa.int64()), pa.array(one["last"] - one["first"], pa.int16()),
                        pa.array(one["gram"].view(np.int64)), pa.array(one["context"].view(np.int64)),
                    ],
                    names=["did", "th", "first", "more", "gram", "context"],
                )

    return texts.select("did", "th", "text").mapInArrow(run, "did long, th long, first long, more short, gram long, context long")


def _bodies(wanted: DataFrame) -> DataFrame:
    """(gram, did, th, first, more, alone, body) for texts with their wanted anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 64):
                part = batch.slice(i, 64)
                texts = [t.as_py() or b"" for t in part.column(2).cast(pa.binary())]
                lists = part.column(3)
                row = np.repeat(np.arange(len(part)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
                flat = lists.flatten()
                gram, first, more, alone = (flat.field(k) for k in range(4))
                bodies = [texts[r][a : a + m + LENGTH] for r, a, m in zip(row.tolist(), first.to_pylist(), more.to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [gram, part.column(0).take(pa.array(row)), part.column(1).take(pa.array(row)), first, more, alone, pa.array(bodies, pa.binary())],
                    names=["gram", "did", "th", "first", "more", "alone", "body"],
                )

    return wanted.select("did", "th", "text", "anchors").mapInArrow(run, "gram long, did long, th long, first long, more short, alone boolean, body binary")


def repeated_starts(did: np.ndarray, th: np.ndarray, first: np.ndarray, more: np.ndarray, bodies: list[bytes], keep: str) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest repeated start of each row, -1 without any.

    Strings stand in suffix order up to LENGTH bytes, equal ones by document and place. Within a run of equal ones
    the previous smaller position is the neighbour above, so a string has a longest previous factor of LENGTH or
    more if it has a neighbour above in its run; a later match is the neighbour below.
    """
    counts = more.astype(np.int64) + 1
    ranks = suffix_ranks(bodies, counts)
    row = np.repeat(np.arange(len(bodies)), counts)
    start = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(len(row))
    order = np.lexsort((start, th[row], did[row], ranks))
    same = ranks[order][1:] == ranks[order][:-1]
    if keep == "first":  # a row that stands there twice is no earlier match of itself
        again = np.ones(len(order) - 1 if len(order) else 0, bool)
        for column in (did[row], th[row], start):
            again &= column[order][1:] == column[order][:-1]
        # Of equal places in a run, what holds for the first holds for all.
        lead = np.maximum.accumulate(np.where(np.concatenate([[True], ~again]), np.arange(len(order)), 0)) if len(order) else np.zeros(0, int)
        same = np.concatenate([[False], same])[lead][1:] if len(order) else same
    hit = np.zeros(len(row), bool)
    hit[order[1:]] |= same
    if keep == "none":
        hit[order[:-1]] |= same
    low, high = np.full(len(bodies), -1), np.full(len(bodies), -1)
    found = np.flatnonzero(hit)
    high[row[found]] = start[found]
    low[row[found[::-1]]] = start[found[::-1]]
    return low, high


def _compare(rows: DataFrame, keep: str) -> DataFrame:
    """(did, th, a, b): what is repeated in rows that stand together by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def flush(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            table = pa.Table.from_batches(parts)
            did, th, first, more = (table.column(k).to_numpy() for k in ("did", "th", "first", "more"))
            low, high = repeated_starts(did, th, first, more, table.column("body").to_pylist(), keep)
            at = np.flatnonzero((low >= 0) & (table.column("alone").to_numpy() if keep == "none" else True))
            return pa.RecordBatch.from_arrays([pa.array(did[at]), pa.array(th[at]), pa.array(low[at]), pa.array(high[at] + LENGTH)], names=["did", "th", "a", "b"])

        for batch in batches:
            gram = batch.column(0).to_numpy()
            # Up to the last change of gram, everything is complete.
            change = np.flatnonzero(gram[1:] != gram[:-1]) + 1
            if held and len(gram) and held[-1].column(0)[-1].as_py() != gram[0]:
                change = np.concatenate([[0], change])
            if len(change) and n + change[-1] >= BATCH_ROWS:
                cut = int(change[-1])
                parts = held + ([batch.slice(0, cut)] if cut else [])
                yield flush(parts)
                held, n = [], 0
                batch = batch.slice(cut)
            held.append(batch)
            n += len(batch)
        if n:
            yield flush(held)

    return rows.mapInArrow(run, "did long, th long, a long, b long")


def _compare_apart(rows: DataFrame, keep: str, tables: Tables) -> DataFrame:
    """The same for any number of rows of a gram: strings are brought together one by one, by their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1024):
                part = batch.slice(i, 1024)
                counts = part.column(4).to_numpy().astype(np.int64) + 1
                hashes = string_hashes(part.column(6).to_pylist(), counts)
                row = np.repeat(np.arange(len(part)), counts)
                start = np.repeat(part.column(3).to_numpy() - (np.cumsum(counts) - counts), counts) + np.arange(len(row))
                take = lambda k: part.column(k).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), take(1), take(2), pa.array(start), take(5)], names=["hash", "did", "th", "start", "alone"])

    strings = tables.put(rows.mapInArrow(run, "hash long, did long, th long, start long, alone boolean"))
    place = F.struct("did", "th", "start")
    seen = strings.groupBy("hash").agg(F.count("*").alias("n"), F.min(place).alias("earliest")).filter("n > 1")
    hits = strings.join(seen, "hash")
    hits = hits.filter("alone") if keep == "none" else hits.filter(place > F.col("earliest"))
    return hits.select("did", "th", F.col("start").alias("a"), (F.col("start") + LENGTH).alias("b"))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "none", group_rows: int = GROUP_ROWS) -> DataFrame:
    """(did, th, spans): for documents with repeats their spans in bytes, possibly overlapping, keyed by id and text hash."""
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    texts = _keyed(docs, id_col, text_col)
    tables = Tables(docs.sparkSession, "repeats")
    found = tables.put(_anchors(texts.select("did", "th", "text")))
    # Written first, so that the join has an exchange of its own on both sides and a frequent gram can be split.
    often = tables.put(found.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"))
    found = tables.put(found.join(often, "gram"))
    place = F.struct("did", "th", "first")
    classes = tables.put(found.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(place).alias("earliest")))
    several = tables.put(classes.groupBy("gram").agg(F.count("*").alias("n_classes")).filter("n_classes > 1"))
    told = found.join(classes, ["gram", "context"])
    whole = told.filter("n > 1") if keep == "none" else told.filter((F.col("n") > 1) & (place > F.col("earliest")))
    whole = whole.select("did", "th", F.col("first").alias("a"), (F.col("first") + F.col("more") + LENGTH).alias("b"))
    # One row of each distinct surrounding, where a gram has several.
    left = told.filter(place == F.col("earliest")).join(several, "gram")
    left = left.dropDuplicates(["gram", "context"])
    left = tables.put(left.select("did", "th", "gram", "first", "more", (F.col("n") == 1).alias("alone"), "n_classes"))
    wanted = left.groupBy("did", "th").agg(F.collect_list(F.struct("gram", "first", "more", "alone")).alias("anchors"))
    wanted = F.broadcast(wanted) if left.count() <= BROADCAST_ANCHORS else wanted
    distinct = texts.join(wanted, ["did", "th"])
    bodies = _bodies(distinct)
    big = left.groupBy("gram").agg(F.count("*").alias("rows")).filter(F.col("rows") > group_rows).select("gram")
    big = settle(big)
    near = _compare(bodies.join(big, "gram", "left_anti").repartition("gram").sortWithinPartitions("gram"), keep)
    spans = whole.unionByName(near)
    if big.take(1):
        spans = spans.unionByName(_compare_apart(bodies.join(big, "gram"), keep, tables))
    merged = tables.put(_merged(spans))
    tables.drop(merged)  # what was needed on the way
    return merged.groupBy("did", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _merged(spans: DataFrame) -> DataFrame:
    """Spans with those that overlap or touch as one, within blocks of a text, so that a text gives few rows whatever repeats in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["did", "th", "block", "a", "b"]
        last: list[int] | None = None  # the span that may still grow
        for batch in batches:
            rows = np.stack([batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names])
            if last is not None:
                rows = np.concatenate([np.array(last)[:, None], rows], axis=1)
            if not rows.shape[1]:
                continue
            new = np.concatenate([[True], (rows[:3, 1:] != rows[:3, :-1]).any(axis=0)])
            # Ends so far within a text: in each text they are lifted above all of the texts before.
            lift = np.cumsum(new) * (np.int64(rows[4].max()) + 1)
            ends = np.maximum.accumulate(rows[4] + lift) - lift
            starts = np.flatnonzero(new | np.concatenate([[True], rows[3, 1:] > ends[:-1]]))
            stops = np.append(starts[1:], rows.shape[1]) - 1
            last = [*rows[:4, starts[-1]].tolist(), int(ends[stops[-1]])]
            done = starts[:-1]
            yield pa.RecordBatch.from_arrays([*(pa.array(rows[i, done]) for i in (0, 1, 3)), pa.array(ends[stops[:-1]])], names=["did", "th", "a", "b"])
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (last[0], last[1], last[3], last[4])], names=["did", "th", "a", "b"])

    blocks = spans.withColumn("block", F.expr(f"a div {repeats._PIECE}")).select("did", "th", "block", "a", "b")
    return blocks.repartition("did", "th", "block").sortWithinPartitions("did", "th", "block", "a").mapInArrow(run, "did long, th long, a long, b long")




def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("did"), F.xxhash64(text).alias("th"), text.alias("text")
    )


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "none", with_bytes: bool = False, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end in bytes) and, if asked for, the bytes kept."""
    require(docs, id_col, text_col)
    spans = repeated_spans(docs, id_col, text_col, keep, group_rows)
    joined = _keyed(docs, id_col, text_col).join(spans, ["did", "th"], "left").select("doc_id", "text", "spans")
    kind = joined.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, found in zip(batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()):
                data = text.as_py() or b""
                gone = merge([(s["a"], s["b"]) for s in found or ()])
                ends = [0, *(x for span in gone for x in span), len(data)]
                kept = b"".join(data[a:b] for a, b in zip(ends[0::2], ends[1::2]))
                own = [{"start": a, "end": b} for a, b in gone]
                rows.append((len(data), len(data) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), own, kept if with_bytes else None))
            columns = list(zip(*rows)) if rows else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            )

    out = joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary")
    return out if with_bytes else out.drop("kept")
