"""Records of a delimited file, found in parallel although texts in quotes may hold line breaks.

A file is read as lines, in blocks. Whether a line begins inside a quoted text depends on all lines before it,
but what it does to that state does not: it keeps it, turns it round, or sets it. Lines are judged for
themselves, blocks are composed of their lines and the file of its blocks, and then each line knows where it
begins. Lines that begin outside of quotes begin a record; others are added to the one before.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyward.operators.ordered import numbered


def _ends_inside(line: Column, delimiter: str) -> Column:
    """Whether a line that begins outside of quotes ends within them."""
    d = re.escape(delimiter)
    text = r'[^"]*+(?:""[^"]*+)*+'
    left = F.regexp_replace(line, rf'(^|{d})"{text}"(?={d}|\r?$)', "$1")
    return left.rlike(rf'(?:^|{d})"{text}$')


def judged_lines(spark: SparkSession, path: str, delimiter: str) -> DataFrame:
    """value, block, at (order within the block), out and inn: whether the line ends in quotes if it begins outside or inside of them."""
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    first = (F.col("block") == 0) & F.col("value").startswith("﻿")  # a mark of the encoding
    lines = lines.withColumn("value", F.when(first, F.expr("substring(value, 2)")).otherwise(F.col("value")))
    closing = r'^[^"]*+(?:""[^"]*+)*+"'
    rest = F.concat(F.lit("x"), F.regexp_replace("value", closing, ""))
    inn = F.when(F.col("value").rlike(closing), _ends_inside(rest, delimiter)).otherwise(F.lit(True))
    return lines.withColumns({"out": _ends_inside(F.col("value"), delimiter), "inn": inn})


def _state(begin: Column, fixed: Column, turns: Column) -> Column:
    """The state behind some lines: set by the last that sets it, if any, and turned by those behind that one."""
    return ((F.coalesce(fixed, begin).cast("int") + turns) % 2) == 1


def _folded(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """fixed and turns of all rows up to each one, itself included, from ``sets`` and ``turn`` of each."""
    upto = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__turns", F.sum(F.col("turn").cast("int")).over(upto))
    df = df.withColumn("__held", F.last(F.when(F.col("sets").isNotNull(), F.struct("sets", F.col("__turns").alias("turns"))), ignorenulls=True).over(upto))
    return df.withColumns({"fixed": F.col("__held.sets"), "turns": F.col("__turns") - F.coalesce(F.col("__held.turns"), F.lit(0))}).drop("__turns", "__held")


def spanning_records(lines: DataFrame) -> DataFrame:
    """text, place: the records of judged lines, whole, where some hold line breaks. A task holds the lines of one block."""
    lines = lines.withColumns({"sets": F.when(F.col("out") == F.col("inn"), F.col("out")), "turn": F.col("out") & ~F.col("inn")})
    within = _folded(lines, ["block"], "at")
    blocks = within.groupBy("block").agg(F.max_by(F.struct("fixed", "turns"), "at").alias("end")).select("block", "end.fixed", (F.col("end.turns") % 2 == 1).alias("odd"))
    blocks = blocks.select("block", (F.col("fixed") != F.col("odd")).alias("sets"), (F.col("fixed").isNull() & F.col("odd")).alias("turn"))
    blocks = _folded(blocks.withColumn("file", F.lit(0)), ["file"], "block")  # a row for each block
    ends = _state(F.lit(False), F.col("fixed"), F.col("turns"))
    begins = blocks.select(F.col("block").alias("b"), F.coalesce(F.lag(ends).over(Window.partitionBy("file").orderBy("block")), F.lit(False)).alias("begin"))
    known = within.join(begins, F.col("block") == F.col("b")).drop("b")
    known = known.withColumn("after", _state(F.col("begin"), F.col("fixed"), F.col("turns")))
    before = F.coalesce(F.lag("after").over(Window.partitionBy("block").orderBy("at")), F.col("begin"))
    known = known.select("value", "block", "at", "after", (~before).alias("starts"))
    own = F.sum(F.col("starts").cast("long")).over(Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    known = known.withColumn("own", own)
    sizes = known.groupBy("block").agg(F.max("own").alias("n")).withColumn("file", F.lit(0))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = known.join(sizes.select(F.col("block").alias("b"), earlier.alias("earlier")), F.col("block") == F.col("b")).withColumn("place", F.col("own") + F.col("earlier"))
    whole = known.where("starts AND NOT after").select(F.col("value").alias("text"), "place")
    parts = known.where("NOT (starts AND NOT after)").groupBy("place").agg(F.sort_array(F.collect_list(F.struct("block", "at", "value"))).alias("lines"))
    return whole.unionByName(parts.select(F.array_join("lines.value", "\n").alias("text"), "place"))


def records(spark: SparkSession, path: str, delimiter: str) -> tuple[DataFrame, bool]:
    """(text of the records of one file, whether place tells their order; else they are in order as they stand)."""
    lines = judged_lines(spark, path, delimiter)
    if lines.agg(F.max("out")).first()[0]:
        return spanning_records(lines), True
    return lines.select(F.col("value").alias("text")), False


def in_order(rows: DataFrame, name: str) -> DataFrame:
    """Dense ids by place, from 0."""
    return numbered(rows, "place", name=name).drop("place")
