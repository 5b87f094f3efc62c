"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A document of weight w and uniform number u (a hash of its id) has the key
-ln(u)/w; in the order of these keys a prefix is a weighted sample without
replacement. A source whose target exceeds its size gives complete epochs
first; the rest of its budget is the prefix of its key order that fits.

The prefix is found without sorting a source: two rounds of counting words
under key boundaries narrow the cut down to a few documents, and only those
are sorted. A source that holds most rows is therefore no hot partition.

Defined cases: null texts have size 0 and weight 1; null sources form one
source, ordered last; rows without an id are told apart by their text; equal keys are ordered by id
and size, and rows equal in both are interchangeable; without words all targets
are 0; an empty table gives an empty result; columns other than those named are
never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.llm.common import WORD, n_words, require, settle

#: Buckets to an octave of the key in the first round, and parts of a bucket in the second.
_OCTAVE, _PARTS = 256, 4096
#: Parts into which the rows of a source are dealt when they meet its plan.
SALTS = 64
_SYMBOLS = "#*$%&|<>"


def symbol_weight(text: Column) -> Column:
    """Quality weight of a text, 1 for clean prose and at least 0.05: it falls with the share of symbols."""
    share = (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))) / F.greatest(F.length(text), F.lit(1))
    return F.coalesce(F.greatest(F.lit(0.05), 1 - 10 * share), F.lit(1.0))


def uniform(id_col: Column, seed: int, text: Column | None = None) -> Column:
    """A number between 0 and 1, from 52 bits of a hash of the id, or of the text where there is no id."""
    other = F.lit("") if text is None else F.concat(F.lit("text "), F.xxhash64(text).cast("string"))
    digits = F.substring(F.md5(F.concat(F.coalesce(id_col.cast("string"), other), F.lit(f":{seed}"))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 52)


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Targets for (source, source_size): all sizes times share, dealt by weight, none above most times its size.

    Sharing out the excess again until no target is above its limit ends where the
    smallest limits for their weight are used up and the rest have one rate for each
    unit of weight; that rate is the greatest of those found by filling the limits in order.
    Works on one row for each source.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(named) - 1, F.lit(len(weights))) + 1
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int")))
    rows = rows.withColumn("most", most * F.col("source_size"))
    filled = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = share * F.sum("source_size").over(everything)
    rows = rows.withColumn("rate", (total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    rows = rows.withColumn("rate", F.max("rate").over(everything))
    return rows.select("source", "source_size", F.least("most", F.col("rate") * F.col("weight")).alias("target"))


def _match(left: DataFrame, right: DataFrame, *names: str, how: str = "inner") -> DataFrame:
    """Join on equal values, where nulls are equal."""
    on = F.lit(True)
    for name in names:
        right = right.withColumnRenamed(name, f"right_{name}")
        on &= F.col(name).eqNullSafe(F.col(f"right_{name}"))
    return left.join(right, on, how).drop(*[f"right_{name}" for name in names])


def _ready(docs: DataFrame, id_col: str, source_col: str, size: Column | None, weight: Column | None, seed: int, text_col: str) -> list[Column]:
    """doc_id, source, size and key of a document."""
    size = n_words(F.col(text_col)) if size is None else size
    weight = symbol_weight(F.col(text_col)) if weight is None else weight
    key = -F.log(uniform(F.col(id_col), seed, F.col(text_col))) / weight
    return [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.cast("long").alias("size"), key.alias("key")]


def _taken(rows: DataFrame, plan: DataFrame, own: Column, edge: Column) -> DataFrame:
    """Rows with the plan of their source, and ``extra``, the words taken beyond complete epochs.

    A source may hold most rows, so its plan is repeated for every value of a salt.
    """
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "key"), F.lit(SALTS)))
    plan = plan.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    joined = _match(rows, plan, "source", "salt", how="left")
    extra = F.when(F.col("edge").isNull(), 0).when(own < edge, F.col("size")).when(own == edge, F.col("piece")).otherwise(0)
    return joined.withColumn("extra", extra.cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", size: Column | None = None, weight: Column | None = None, targets: DataFrame | None = None, seed: int = 7, text_col: str = "text") -> DataFrame:
    """Words to take from every document.

    Returns doc_id, source, size, source_size, target, epochs (complete passes over
    its source), taken (words, repeats counted). The words of a source add up to its
    target, rounded: the one document on the cut gives only its first words.
    """
    require(docs, id_col, source_col)
    rows, plan = _plan(docs, _ready(docs, id_col, source_col, size, weight, seed, text_col), targets)
    taken = _taken(rows, plan, F.struct("key", "doc_id", "size", "nr"), F.col("edge"))
    return taken.select(
        "doc_id", "source", "size", "source_size", "target", "epochs", (F.col("epochs") * F.col("size") + F.col("extra")).alias("taken")
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: int = 7, targets: DataFrame | None = None) -> DataFrame:
    """The mix itself, with all columns of the documents: a row for each time that a document is taken.

    The document on the cut of a source gives its first words, joined by spaces, in a
    row of its own (as does each row that has its id and size). n_chars, if there, stays true.
    """
    require(docs, id_col, source_col, text_col)
    ready = _ready(docs, id_col, source_col, None, None, seed, text_col)
    _, plan = _plan(docs, ready, targets)
    own = docs.select(F.struct(*docs.columns).alias("doc"), *ready)
    edge = F.struct(F.col("edge.key"), F.col("edge.doc_id"), F.col("edge.size"))
    taken = _taken(own, plan, F.struct("key", "doc_id", "size"), edge)
    times = F.col("epochs") + (F.col("extra") > 0).cast("long")
    copies = taken.filter(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times)))
    partial = (F.col("copy") > F.col("epochs")) & (F.col("extra") < F.col("size"))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("doc")[text_col], F.lit(WORD), F.lit(0)), F.lit(1), F.col("extra").cast("int")), " ")
    text = F.when(partial, head).otherwise(F.col("doc")[text_col])
    columns = [F.col("doc")[c].alias(c) for c in docs.columns]
    columns[docs.columns.index(text_col)] = text.alias(text_col)
    if "n_chars" in docs.columns:
        columns[docs.columns.index("n_chars")] = F.when(partial, F.length(head)).otherwise(F.col("doc")["n_chars"]).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return copies.select(*columns)


def _plan(docs: DataFrame, ready: list[Column], targets: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The narrow rows, settled, and for each source its size, target, epochs, and where it is cut: edge and piece."""
    rows = docs.select(*ready, F.monotonically_increasing_id().alias("nr"))
    rows = settle(rows.withColumn("slot", F.floor(F.log2("key") * _OCTAVE)))

    # Round 1: words of each source by key bucket. At most some thousand buckets a source.
    buckets = settle(rows.groupBy("source", "slot").agg(F.sum("size").alias("words"), F.min("key").alias("low"), F.max("key").alias("high")))
    if targets is None:
        targets = source_targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")))
    goals = targets.withColumn("goal", F.floor(F.col("target") + 0.5).cast("long"))
    goals = goals.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("goal") / F.col("source_size"))).otherwise(0).cast("long"))
    goals = settle(goals.withColumn("rest", F.col("goal") - F.col("epochs") * F.col("source_size")))

    def cut(parts: DataFrame, order: str) -> DataFrame:
        """Of the parts of each source in order, the first whose words go beyond the rest; the rest less those before it."""
        run = F.sum("words").over(Window.partitionBy("source").orderBy(order))
        first = F.row_number().over(Window.partitionBy("source").orderBy(order))
        beyond = parts.withColumn("upto", run).filter(F.col("upto") > F.col("rest")).withColumn("first", first).filter("first = 1")
        return beyond.withColumn("rest", F.col("rest") - (F.col("upto") - F.col("words"))).drop("first", "upto", "words")

    at = cut(_match(buckets, goals.select("source", "rest"), "source"), "slot")
    # Round 2: the bucket with the cut, in finer parts.
    inside = _match(rows, at, "source", "slot")
    span = F.when(F.col("high") > F.col("low"), (F.col("key") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    inside = settle(inside.withColumn("part", F.floor(span * _PARTS)))
    parts = inside.groupBy("source", "part").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    at = cut(parts, "part")
    # The few documents left are sorted.
    last = _match(inside.drop("rest"), at, "source", "part")
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size", "nr")
    last = last.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("upto") > F.col("rest"))
    last = last.withColumn("first", F.row_number().over(order)).filter("first = 1")
    last = last.select("source", F.struct("key", "doc_id", "size", "nr").alias("edge"), (F.col("rest") - F.col("upto") + F.col("size")).alias("piece"))

    return rows, settle(_match(goals.drop("goal", "rest"), last, "source", how="left"))
