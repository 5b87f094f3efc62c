"""Sharding by histogram sort, in DataFrame operations only.

Every document has a key, 60 bits of a hash of its id, so equal texts spread
over all keys. The boundaries between shards are found by counting: each round
sums the exact bytes below some thousand probe keys, and keeps for each
boundary the interval that holds its goal, until the interval holds a single
row (or the bytes in it are within the tolerance). Where one key holds the goal of a boundary and many
rows, the search goes on among these rows, by a hash of text and place in the input. Then rows move once, to
their place in their shard.

The law is ``bytes``: with b bytes on smaller keys and t in all, a document is in
shard floor(b * shards / t). Shards differ by about one document. Equal texts are not kept together: one
that many documents share would not fit into a shard.

Defined cases: a null text has no bytes and counts as 1, as an empty one does; a null id is hashed as
the empty string; rows that repeat an id, or are equal, are split like others, equal ones being
interchangeable; a very long text makes its shard longer by at most its size; an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.llm.common import require, settle

KEY_BITS, SUB_BITS = 60, 31
#: Probe keys of a round, and rows of a bucket in which positions are counted, about.
PROBES, BUCKET_ROWS = 4096, 8192


def shard_key(id_col: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit(""))), 1, KEY_BITS // 4), 16, 10).cast("long")


def _search(rows: DataFrame, pending: dict[int, tuple[int, int, int]], shards: int, total: int, tolerance: int) -> dict[int, tuple[int, bool, int]]:
    """For boundaries with (interval, bytes below it): (key from which the next shard begins, whether that splits
    the rows well enough, bytes below the last key). What comes to the driver is at most a row for each probe."""
    done: dict[int, tuple[int, bool, int]] = {}
    while pending:
        intervals = sorted({x[:2] for x in pending.values()})
        probes = max(2, PROBES // len(intervals))
        where = part = F.lit(None).cast("int")
        for i, (low, high) in reversed(list(enumerate(intervals))):
            step = -(-(high - low) // probes)
            inside = (F.col("key") >= low) & (F.col("key") < high)
            where = F.when(inside, i).otherwise(where)
            part = F.when(inside, F.expr(f"cast((key - {low}) div {step} as int)")).otherwise(part)
        found = rows.select(where.alias("i"), part.alias("part"), "size").filter("i is not null")
        held: list[dict[int, tuple[int, int]]] = [{} for _ in intervals]
        for r in found.groupBy("i", "part").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():
            held[r["i"]][r["part"]] = (r["size"], r["n"])
        for j, (low, high, below) in list(pending.items()):
            step = -(-(high - low) // probes)
            own = held[intervals.index((low, high))]
            for k in sorted(own):
                size, n = own[k]
                if shards * (below + size) >= j * total:
                    start, stop = low + k * step, min(high, low + (k + 1) * step)
                    if n == 1 or size <= tolerance or stop - start == 1:
                        done[j] = stop, n == 1 or size <= tolerance, below
                        del pending[j]
                    else:
                        pending[j] = (start, stop, below)
                    break
                below += size
            else:  # no rows at all
                done[j] = high, True, below
                del pending[j]
    return done


def find_splitters(rows: DataFrame, shards: int, tolerance: int = 0) -> tuple[list[tuple[int, int]], int]:
    """(boundaries, rows) of a table of (key, sub, size); a boundary is the (key, sub) from which a shard begins."""
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    found = _search(rows, {j: (0, 1 << KEY_BITS, 0) for j in range(1, shards)}, shards, total, tolerance)
    out = {j: (stop, 0) for j, (stop, _, _) in found.items()}
    crowded: dict[int, dict[int, int]] = {}
    for j, (stop, split, below) in found.items():
        if not split:
            crowded.setdefault(stop - 1, {})[j] = below
    for key, own in crowded.items():
        inner = rows.filter(F.col("key") == key).select(F.col("sub").alias("key"), "size")
        deeper = _search(inner, {j: (0, 1 << SUB_BITS, below) for j, below in own.items()}, shards, total, tolerance)
        out |= {j: (key, stop) for j, (stop, _, _) in deeper.items()}
    return [out[j] for j in sorted(out)], count


def shard_documents(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", tolerance: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard, in key order) of every row."""
    require(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        shard_key(F.col(id_col)).alias("key"),
        F.monotonically_increasing_id().alias("nr"),
    )
    rows = settle(narrow.withColumn("sub", F.pmod(F.xxhash64("text_crc32", "nr"), F.lit(1 << SUB_BITS))))
    splitters, count = find_splitters(rows.select("key", "sub", "size"), shards, tolerance)
    shard = F.lit(0)
    for key, sub in splitters:
        shard = shard + F.when((F.col("key") > key) | (F.col("key") == key) & (F.col("sub") >= sub), 1).otherwise(0)
    width = max(1, (1 << KEY_BITS) // max(1, count // BUCKET_ROWS))
    rows = rows.withColumn("shard", shard.cast("int")).withColumn("bucket", F.expr(f"key div {width}"))
    held = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    # Rows that share an id fall into one bucket; where they make it large, parts of each key are buckets of their own.
    large = settle(held.filter(F.col("n") > 4 * BUCKET_ROWS).select("shard", "bucket", F.lit(True).alias("large")))
    at = ["shard", "bucket"]
    if large.take(1):
        rows = rows.join(large, at, "left").withColumns({"own": F.when(F.col("large"), F.col("key")), "part": F.when(F.col("large"), F.shiftright("sub", SUB_BITS - 16))}).fillna(0, ["own", "part"])
        at += ["own", "part"]
        held = rows.groupBy(*at).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy(*at[1:]).rowsBetween(Window.unboundedPreceding, -1)
    starts = held.select(*at, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy(*at).orderBy("key", "sub", "nr"))
    return rows.join(starts, at).select("doc_id", "size", "text_crc32", "shard", (F.col("start") + place - 1).cast("long").alias("slot"))
