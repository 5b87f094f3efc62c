"""The trie of conversation prefixes.

Turns (role and text) are encoded as whole numbers by a dictionary; a conversation becomes rows
(conversation, position, turn), with a mark behind its last turn. A bucket holds the
conversations that share a prefix. It begins with all of them; in each round every large bucket

* is walked as long as its conversations agree (counts, least and largest turn of each position):
  the nodes of that stretch are known at once, however many conversations or turns there are;
* is dealt by the turn at the first position where they differ: the digit of a radix
  partitioning with the most significant digit first.

Buckets of at most LOCAL rows leave the rounds and are finished by multikey quicksort, many
to a task, one in memory at a time; the recursion emits their nodes. Totals of subtrees go
up bucket by bucket, round by round. No bucket is ever gathered that has more than LOCAL
rows, so hot prefixes, groups of copies and very long conversations stay spread.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.llm.common import Tables, require
from tallyward.operators.ordered import numbered

#: Rows of a bucket that one task may hold.
LOCAL = 4096
#: Most turns that are taken over from another conversation.
HEAD = 8
#: Turn numbers of the place before the first turn and behind the last.
ROOT, END = -2, -1
#: Ids of a piece of text that is hashed, and positions of a block of a running total.
PIECE, BLOCK = 8192, 4096
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def coded_turns(conversations: DataFrame, tables: Tables) -> DataFrame:
    """conv_id, r (place in the conversation from 0), size (turns), tid (number of role and text in the dictionary), bytes."""
    require(conversations, "conv_id", "turn", "role", "text")
    c = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL")
    both = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    narrow = c.select(
        "conv_id", "turn", F.left("role", F.lit(32)).alias("role"), F.left("text", F.lit(32)).alias("start"),
        F.unhex(F.sha2(both, 256)).alias("key"), F.octet_length("text").cast("long").alias("bytes"),
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("start"), F.col("key"), F.monotonically_increasing_id()]
    placed = numbered(narrow, *order, name="place").select("conv_id", "place", "key", "bytes")
    dictionary = tables.put(placed.groupBy("key").agg(F.max("bytes").alias("b")).select("key", F.monotonically_increasing_id().alias("tid")))
    rows = tables.put(placed.join(dictionary, "key").select("conv_id", "place", "tid", "bytes"))
    spans = rows.groupBy("conv_id").agg(F.min("place").alias("start"), F.count("*").alias("size"))
    return tables.put(rows.join(spans, "conv_id").select("conv_id", (F.col("place") - F.col("start")).alias("r"), "size", "tid", "bytes"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """c, len, pos, tid, bytes: conversations with the first turns of another one in front, and marks at both ends."""
    heads = turns.where(f"r < {HEAD}").groupBy("conv_id").agg(F.max("size").alias("size"), F.sort_array(F.collect_list(F.struct("r", "tid", "bytes"))).alias("head"))
    own = heads.select(F.col("conv_id").alias("c"), "size", (F.crc32(F.col("conv_id").cast("string")) % (HEAD + 1)).alias("h"))
    other = heads.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"), "head")
    plan = own.join(other, F.col("c") - F.col("c") % 5 == F.col("base"), "left")
    taken = F.least("h", F.coalesce("base_size", F.lit(0)))
    plan = plan.withColumns({"taken": taken, "len": taken + F.greatest(F.col("size") - F.col("h"), F.lit(0))})
    mark = lambda pos, tid: plan.select("c", "len", pos.cast("long").alias("pos"), F.lit(tid).cast("long").alias("tid"), F.lit(0).cast("long").alias("bytes"))
    front = plan.select("c", "len", F.explode(F.slice("head", F.lit(1), F.col("taken").cast("int"))).alias("t")).select("c", "len", F.col("t.r").alias("pos"), "t.tid", "t.bytes")
    rest = turns.join(plan.select("c", "len", "h", "taken"), F.col("conv_id") == F.col("c")).where("r >= h").select("c", "len", (F.col("r") - F.col("h") + F.col("taken")).alias("pos"), "tid", "bytes")
    return mark(F.lit(-1), ROOT).unionByName(front).unionByName(rest).unionByName(mark(F.col("len"), END))


def _key(a: DataFrame, b: DataFrame, *names: str) -> Column:
    condition = F.lit(True)
    for n in names:
        condition = condition & (a[n] == b[n])
    return condition


def build(rows: DataFrame, tables: Tables) -> DataFrame:
    """All nodes of the trie of rebuilt conversations."""
    spark = rows.sparkSession
    rows = tables.put(rows)
    least = rows.agg(F.min("c")).first()[0]
    if least is None:
        return spark.createDataFrame([], NODE)
    # A bucket is the node (bm, bs): its least conversation, and how many turns it shares. pm is the parent's.
    active = rows.select(F.lit(least).alias("bm"), F.lit(0).cast("long").alias("bs"), F.lit(None).cast("long").alias("pm"), *rows.columns)
    rounds: list[tuple[DataFrame, DataFrame]] = []
    local: list[DataFrame] = []
    while True:
        stats = active.groupBy("bm", "bs", "pm", "pos").agg(F.count("*").alias("n"), F.min("tid").alias("lo"), F.max("tid").alias("hi"), F.max("bytes").alias("bytes"))
        stats = tables.put(stats)
        cuts = stats.where(f"lo <> hi OR lo = {END}").groupBy("bm", "bs").agg(F.min("pos").alias("cut"))
        chain = tables.put(stats.join(cuts, ["bm", "bs"]).where("pos < cut").select("bm", "bs", "pm", "pos", "cut", "n", "bytes"))
        at = tables.put(active.join(cuts, ["bm", "bs"]).where("pos = cut").select("bm", "bs", "cut", "c", "len", "tid"))
        rounds.append((chain, at.where(f"tid = {END}").select("bm", "cut", "c")))
        kids = at.where(f"tid <> {END}").groupBy("bm", "bs", "tid").agg(F.min("c").alias("m"), F.sum(F.col("len") - F.col("cut") + 1).alias("rows"))
        kids = tables.put(kids)
        if kids.isEmpty():
            break
        assigned = at.join(kids, ["bm", "bs", "tid"]).select("c", F.col("bm").alias("pm"), F.col("m").alias("bm"), (F.col("cut") + 1).alias("bs"), "rows")
        rest = active.drop("bm", "bs", "pm").join(assigned, "c").where("pos >= bs - 1")
        placed = tables.put(rest.select(F.lit(len(rounds)).alias("level"), "bm", "bs", "pm", "c", "len", "pos", "tid", "bytes", "rows"))
        local.append(placed.where(f"rows <= {LOCAL}").drop("rows"))
        active = placed.where(f"rows > {LOCAL}").drop("rows", "level")
        if active.isEmpty():
            break
    nodes = None
    if local:
        gathered = local[0]
        for more in local[1:]:
            gathered = gathered.unionByName(more)
        gathered = gathered.select("level", "bm", "bs", "pm", "c", "pos", "tid", "bytes")
        nodes = tables.put(gathered.repartition("bm", "bs").sortWithinPartitions("bm", "bs", "c", "pos").mapInArrow(_finish, f"{NODE}, level int, top boolean"))
    return _joined(rounds, nodes, tables)


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of small buckets, whose rows come one bucket after the other."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(8)]
        held = columns if held is None else [np.concatenate(x) for x in zip(held, columns)]
        edges = [0, *(np.flatnonzero((np.diff(held[1]) != 0) | (np.diff(held[2]) != 0)) + 1).tolist()]
        if len(edges) > 1:
            yield _node_batch([n for a, b in zip(edges, edges[1:]) for n in bucket_nodes(*(x[a:b] for x in held))])
            held = [x[edges[-1] :] for x in held]
    if held is not None and len(held[0]):
        yield _node_batch(bucket_nodes(*held))


def _node_batch(nodes: list[list]) -> pa.RecordBatch:
    kinds = [*[pa.int64()] * 7, pa.string(), pa.int32(), pa.bool_()]
    names = [x.split()[0] for x in NODE.split(", ")] + ["level", "top"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*nodes), kinds)], names=names)


def bucket_nodes(level: np.ndarray, bm: np.ndarray, bs: np.ndarray, pm: np.ndarray, c: np.ndarray, pos: np.ndarray, tid: np.ndarray, size: np.ndarray) -> list[list]:
    """The nodes of one bucket by multikey quicksort, parents first. Rows are ordered by conversation and position, from bs - 1 on."""
    starts = [0, *(np.flatnonzero(np.diff(c)) + 1).tolist()]
    convs, turns, sizes = c[starts].tolist(), tid.tolist(), size.tolist()
    shift, top, before = 1 - int(bs[0]), int(bs[0]), int(pm[0])
    nodes: list[list] = []

    def emit(members: list[int], depth: int, parent: int) -> int:
        above = nodes[parent][0] if parent >= 0 else before
        last = sizes[starts[members[0]] + depth - 1 + shift]
        nodes.append([convs[members[0]], depth, above, len(members), 0, 0, (len(members) - 1) * last, NOTHING, int(level[0]), parent < 0, parent])
        if parent >= 0:
            nodes[parent][4] += 1
        return len(nodes) - 1

    everyone = list(range(len(convs)))
    work = [(everyone, top, emit(everyone, top, -1))]
    while work:
        members, depth, parent = work.pop()
        keys = [turns[starts[i] + depth + shift] for i in members]
        pivot = keys[len(keys) // 2]
        less = [i for i, k in zip(members, keys) if k < pivot]
        more = [i for i, k in zip(members, keys) if k > pivot]
        work += [(part, depth, parent) for part in (less, more) if part]
        equal = [i for i, k in zip(members, keys) if k == pivot] if less or more else members
        if pivot == END:
            nodes[parent][7] = hashlib.sha256(",".join(str(convs[i]) for i in equal).encode()).hexdigest()
        else:
            work.append((equal, depth + 1, emit(equal, depth + 1, parent)))
    for node in reversed(nodes):  # children come behind their parents
        node[5] = node[5] or 1
        parent = node.pop()
        if parent >= 0:
            nodes[parent][5] += node[5]
            nodes[parent][6] += node[6]
    return nodes


def _joined(rounds: list[tuple[DataFrame, DataFrame]], nodes: DataFrame | None, tables: Tables) -> DataFrame:
    """Nodes of the stretches of large buckets, with the totals of what lies below, and those of small buckets."""
    ends = rounds[0][1]
    for _, more in rounds[1:]:
        ends = ends.unionByName(more)
    digests = tables.put(end_digests(ends))
    upper: list[DataFrame] = []
    tops = None  # of the round below: parent, depth of the parent, totals
    for k in range(len(rounds) - 1, -1, -1):
        chain = rounds[k][0]
        if nodes is not None:
            small = nodes.where(f"top AND level = {k + 1}").select(F.col("parent_conv_id").alias("pm"), (F.col("depth") - 1).alias("cut"), "n_leaves", "saved_tokens")
            tops = small if tops is None else small.unionByName(tops)
        own = chain.groupBy("bm", "bs", "pm", "cut").agg(F.sum((F.col("n") - 1) * F.col("bytes")).alias("saved"))
        if tops is None:
            below = own.selectExpr("bm", "cut", "0L AS kids", "0L AS leaves", "0L AS under").where("false")
        else:
            below = tops.groupBy(F.col("pm").alias("bm"), "cut").agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("under"))
        own = own.join(below, ["bm", "cut"], "left")
        own = own.withColumns({"kids": F.coalesce("kids", F.lit(0)), "leaves": F.coalesce("leaves", F.lit(1)), "under": F.coalesce("under", F.lit(0))})
        own = tables.put(own)
        tops = own.where("pm IS NOT NULL").select("pm", (F.col("bs") - 1).alias("cut"), F.col("leaves").alias("n_leaves"), (F.col("saved") + F.col("under")).alias("saved_tokens"))
        upper.append(_stretch(chain, own, digests))
    for more in upper:
        nodes = more if nodes is None else nodes.select(*more.columns).unionByName(more)
    return nodes


def _stretch(chain: DataFrame, own: DataFrame, digests: DataFrame) -> DataFrame:
    """The nodes of the stretches of a round; savings are summed from the far end in blocks."""
    weighed = chain.withColumns({"w": (F.col("n") - 1) * F.col("bytes"), "block": F.floor(F.col("pos") / BLOCK)})
    by_block = weighed.groupBy("bm", "bs", "block").agg(F.sum("w").alias("total"))
    behind = F.coalesce(F.sum("total").over(Window.partitionBy("bm", "bs").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_block = by_block.select("bm", "bs", "block", behind.alias("behind"))
    here = F.sum("w").over(Window.partitionBy("bm", "bs", "block").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0))
    rows = weighed.withColumn("here", here).join(by_block, ["bm", "bs", "block"]).join(own.select("bm", "bs", "kids", "leaves", "under"), ["bm", "bs"])
    rows = rows.join(digests, ["bm", "cut"], "left")
    last = F.col("pos") + 1 == F.col("cut")
    return rows.select(
        F.col("bm").alias("conv_id"),
        (F.col("pos") + 1).alias("depth"),
        F.when(F.col("pos") + 1 == F.col("bs"), F.col("pm")).otherwise(F.col("bm")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(last, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("here") + F.col("behind") + F.col("under")).alias("saved_tokens"),
        F.when(last, F.coalesce("digest", F.lit(NOTHING))).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )


def end_digests(ends: DataFrame) -> DataFrame:
    """bm, cut, digest: SHA-256 of the ids c of each (bm, cut), in order and joined by commas.

    A hash is computed in one go, so the ids of one node meet in one task, but as texts of PIECE ids made
    beforehand by range, and they stream through.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bm, cut, c = (batch.column(i).to_numpy() for i in range(3))
            edges = np.unique([0, len(bm), *range(0, len(bm), PIECE), *(np.flatnonzero((np.diff(bm) != 0) | (np.diff(cut) != 0)) + 1)]).tolist()
            spans = list(zip(edges, edges[1:]))
            columns = [[x[a] for a, _ in spans] for x in (bm, cut, c)] + [[",".join(map(str, c[a:b].tolist())) for a, b in spans]]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, [pa.int64()] * 3 + [pa.string()])], names=["bm", "cut", "c", "piece"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        names = ["bm", "cut", "digest"]
        for batch in batches:
            done: list[tuple] = []
            for bm, cut, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                if (bm, cut) == key:
                    running.update(b",")
                else:
                    if key is not None:
                        done.append((*key, running.hexdigest()))
                    key, running = (bm, cut), hashlib.sha256()
                running.update(piece.as_py().encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, running.hexdigest())], names=names)

    ordered = ends.repartitionByRange("bm", "cut", "c").sortWithinPartitions("bm", "cut", "c")
    texts = ordered.mapInArrow(pieces, "bm long, cut long, c long, piece string")
    return texts.repartition("bm", "cut").sortWithinPartitions("bm", "cut", "c").mapInArrow(digest, "bm long, cut long, digest string")


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, one row each.

    A row without conv_id belongs to no conversation and is left out. Turns are ordered by turn, null first; at a
    tie by role, then by the first 32 characters of role and text, then by a digest of both (equal rows are turns
    each). conv_id % 5 is SQL's, so of its own sign for negative ids. Texts of any length count by their bytes;
    further columns are ignored, whatever their names; an empty table has no node, not even a root. Two turns
    are one if the SHA-256 of role and text agree.
    """
    tables = Tables(conversations.sparkSession, "trie")
    return build(rebuilt(coded_turns(conversations, tables)), tables)
