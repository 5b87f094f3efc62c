"""Violations of many rules from one pass over the data: counted together, and fetched together under a cap for each rule.

Rows are told apart by a dense id. The pass that counts also notes in which blocks of ids a rule's
violations lie, so that the pass that fetches reads, for each rule, only up to the block of its last row
under the cap; what is ranked after that is bounded by the cap and a block.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyward.functions.sqltext import quote
from tallyward.operators.checks import ROW

#: Ids of a block.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Check:
    """A condition without windows, in Spark SQL, and the columns whose values a finding tells."""

    key: str
    condition: str
    targets: tuple[str, ...] = ()


def hits(data: DataFrame, checks: Sequence[Check], cells: bool = True) -> DataFrame:
    """(check, row, cells): a row for each check that a row of the data meets; check is its number, cells the values of all targets."""
    names = list(dict.fromkeys(t for c in checks for t in c.targets)) if cells else []
    met = ", ".join(f"CASE WHEN ({c.condition}) THEN {i} END" for i, c in enumerate(checks))
    kept = [F.col(ROW).alias("row"), *([F.struct(*[F.col(quote(n)) for n in names]).alias("cells")] if names else [])]
    return data.select(*kept, F.expr(f"array({met})").alias("__met")).select("*", F.explode("__met").alias("check")).drop("__met").where("check IS NOT NULL")


def extents(data: DataFrame, checks: Sequence[Check], cap: int) -> DataFrame:
    """(check, n, last): how many rows meet each check, and the block that holds the last one under the cap."""
    blocks = hits(data, checks, cells=False).groupBy("check", F.floor(F.col("row") / BLOCK).alias("block")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("check").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    told = blocks.withColumn("before", before)
    return told.groupBy("check").agg(F.sum("n").alias("n"), F.max(F.when(F.col("before") < cap, F.col("block"))).alias("last"))


def capped(data: DataFrame, checks: Sequence[Check], cap: int, found: DataFrame) -> DataFrame:
    """The first rows of each check by id, at most cap, from one scan; found: its extents, a row for each check."""
    last = F.broadcast(found.select(F.col("check").alias("__check"), "last"))
    near = hits(data, checks).join(last, F.col("check") == F.col("__check")).where(F.floor(F.col("row") / BLOCK) <= F.col("last")).drop("__check", "last")
    rank = F.row_number().over(Window.partitionBy("check").orderBy("row"))
    return near.withColumn("__rank", rank).where(F.col("__rank") <= cap).drop("__rank")


#: Severities from the gravest.
SEVERITIES = ("error", "warning", "info")


def merged(flags: DataFrame) -> DataFrame:
    """Findings with equal source, rule, scope, row, column and message as one, with how often they came and when first (``seq``)."""
    key = ["source", "rule_id", "scope", "row", "column", "message"]
    return flags.groupBy(*key).agg(F.min_by("severity", "seq").alias("severity"), F.count("*").alias("times"), F.min("seq").alias("seq"))


def gravest(flags: DataFrame, cap: int) -> DataFrame:
    """At most cap of merged findings: the gravest, of equal severity the earliest.

    Findings are counted by severity and block of their number first; only those up to the block in which the
    cap falls are ranked, so what one task sees is bounded by the cap and a block.
    """
    tier = F.expr("CASE severity " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(SEVERITIES)) + f" ELSE {len(SEVERITIES)} END")
    rows = flags.withColumns({"__tier": tier, "__block": F.floor(F.col("seq") / BLOCK)})
    sizes = rows.groupBy("__tier", "__block").agg(F.count("*").alias("n"))  # a row for each block of each severity
    before = F.coalesce(F.sum("n").over(Window.orderBy("__tier", "__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = sizes.withColumn("before", before).where(F.col("before") < cap).select(F.col("__tier").alias("__t"), F.col("__block").alias("__b"))
    near = rows.join(reached, (F.col("__tier") == F.col("__t")) & (F.col("__block") == F.col("__b")))
    return near.orderBy("__tier", "seq").limit(cap).drop("__tier", "__block", "__t", "__b")
