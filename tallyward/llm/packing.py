"""Best-fit packing into bins of several permitted lengths.

A text longer than the longest bin is cut into pieces of that length and a
remainder. Pieces are dealt into groups of bounded size by a hash, and each
group is packed by itself: longest piece first, into the open bin with the
least room that still fits; if none fits, a bin opens of the length that costs least
per word, given the sizes that still wait. Finally every bin shrinks to the shortest permitted
length that holds its contents.

Only ids and sizes travel, ids as Arrow values, so that none changes its form. Groups are
of bounded size whatever the input, so a task needs bounded memory and tasks grow in number
with the data. A group is told by id, piece and text, not by where a row stands, so another
partitioning packs alike; only a group that equal rows make too large is dealt out by place.

Defined cases: a text without words (null, empty, white space) has one row with
piece 0, no words and no bin; null ids are ids like others; repeated rows are packed as separate
pieces; ties are broken by id, piece and text; a text of any length is cut into pieces of the longest
bin; columns to keep may have any name but those of the result; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import n_words, require, settle

#: Permitted bin lengths in words, the fixed cost of a bin in words, the length whose square costs as much as its words, and pieces of a group, about.
LENGTHS, BIN_COST, SQUARE, GROUP_PIECES = (512, 1024, 2048, 4096), 16, 8192, 16384


def bin_price(length: int, cost: int = BIN_COST) -> float:
    """What a bin costs, in words: its own length, a share for the square of it, as attention has, and a fixed part."""
    return length + length * length / SQUARE + cost


def opening_length(size: int, left: Counter, present: int, lengths: Sequence[int], cost: int = BIN_COST) -> int:
    """The length that costs least per word that it will hold.

    A bin of each length is filled in mind with the pieces that wait, largest first; ``left`` counts them by size,
    ``present`` has a bit for each such size. The price of all lengths is thus weighed against what is left for them.
    """
    best, rate = 0, float("inf")
    for length in lengths:
        if length < size:
            continue
        room, below = length - size, present
        while room and (below := below & ((1 << (room + 1)) - 1)):
            largest = below.bit_length() - 1
            room -= largest * min(left[largest], room // largest)
            below ^= 1 << largest
        if bin_price(length, cost) / (length - room) < rate:
            best, rate = length, bin_price(length, cost) / (length - room)
    return best


def pack_sizes(sizes: Sequence[int], lengths: Sequence[int] = LENGTHS, cost: int = BIN_COST) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, in the given order of pieces, and the final length of each bin."""
    lengths = sorted(lengths)
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    left = Counter(sizes)
    present = sum(1 << size for size in left)
    room: list[list[int]] = [[] for _ in range(lengths[-1] + 1)]  # bins by the words that they still take
    filled = 0  # bit r: room[r] is not empty
    used: list[int] = []
    opened: list[int] = []
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in order:
        size = sizes[i]
        left[size] -= 1
        if not left[size]:
            present ^= 1 << size
        above = filled >> size
        if above:
            r = size + (above & -above).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                filled ^= 1 << r
        else:
            b = len(used)
            used.append(0)
            opened.append(opening_length(size, left, present, lengths, cost))
        bins[i], offsets[i] = b, used[b]
        used[b] += size
        spare = opened[b] - used[b]
        if spare:
            room[spare].append(b)
            filled |= 1 << spare
    return bins, offsets, [next(n for n in lengths if n >= u) for u in used]


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: Column | None = None, lengths: Sequence[int] = LENGTHS, cost: int = BIN_COST, keep: Sequence[str] = ()) -> DataFrame:
    """One row per piece: doc_id, piece, start_word, n_words, bin_id, bin_length, bin_offset, and the columns to keep."""
    require(docs, id_col, text_col, *keep)
    if clash := {"doc_id", "piece", "start_word", "n_words", "bin_id", "bin_length", "bin_offset"}.intersection(keep):
        raise ValueError(f"columns of the result cannot be kept: {', '.join(sorted(clash))}")
    size = n_words(F.col(text_col)) if size is None else size
    longest = max(lengths)
    kept = [F.col(k).alias(f"keep_{i}") for i, k in enumerate(keep)]
    rows = settle(docs.select(F.col(id_col).alias("doc_id"), size.cast("long").alias("size"), F.xxhash64(text_col).alias("text_hash"), F.monotonically_increasing_id().alias("nr"), *kept))
    pieces = rows.withColumn("piece", F.explode(F.expr(f"sequence(0L, greatest(0L, (size - 1) div {longest}))")))
    pieces = pieces.withColumn("start_word", F.col("piece") * longest)
    pieces = pieces.withColumn("n_words", F.least(F.col("size") - F.col("start_word"), F.lit(longest))).drop("size")
    empty, some = pieces.filter("n_words = 0"), pieces.filter("n_words > 0")
    count = rows.select(F.sum(F.expr(f"(size + {longest} - 1) div {longest}"))).first()[0] or 0
    groups = max(1, -(-count // GROUP_PIECES))
    some = some.withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "piece", "text_hash"), F.lit(groups)))
    # Equal rows fall into one group; where they make it large, it is dealt out.
    large = settle(some.groupBy("pack_group").agg(F.count("*").alias("held")).filter(F.col("held") > 4 * GROUP_PIECES))
    if large.take(1):
        some = some.join(large, "pack_group", "left")
        part = F.pmod(F.xxhash64("nr"), F.expr(f"coalesce(held div {GROUP_PIECES}, 1L)"))
        some = some.withColumn("part", part).drop("held")
    else:
        some = some.withColumn("part", F.lit(0).cast("long"))
    names = ["doc_id", *[f"keep_{i}" for i in range(len(keep))], "piece", "start_word", "n_words"]
    kinds = {f.name: f.dataType.simpleString() for f in some.schema}
    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", bin_id long, bin_length long, bin_offset long"

    def pack(key, table):
        table = table.sort_by([("n_words", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("text_hash", "ascending"), ("nr", "ascending")])
        bins, offsets, final = pack_sizes(table.column("n_words").to_pylist(), lengths, cost)
        first = (key[1].as_py() * groups + key[0].as_py()) << 32
        added = [pa.array([first + b for b in bins], pa.int64()), pa.array([final[b] for b in bins], pa.int64()), pa.array(offsets, pa.int64())]
        return pa.table([*(table.column(n) for n in names), *added], names=[*names, "bin_id", "bin_length", "bin_offset"])

    packed = some.groupBy("pack_group", "part").applyInArrow(pack, schema)
    none = F.lit(None).cast("long")
    whole = packed.unionByName(empty.select(*names, none.alias("bin_id"), none.alias("bin_length"), none.alias("bin_offset")))
    return whole.withColumnsRenamed({f"keep_{i}": k for i, k in enumerate(keep)})
