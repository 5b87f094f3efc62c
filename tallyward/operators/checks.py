"""Checks and corrections as DataFrame plans.

Each takes a table with a dense row id and gives a plan; nothing is computed
here. Counting and fetching use the same plan, so what is tested is what is run.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.sqltext import quote
from tallyward.operators.assertions import DIRECTIONS, Assertion, parse_assertion, violation
from tallyward.operators.windows import spread_windows

ROW = "__row__"
_HIT = "__hit__"


def with_hit(data: DataFrame, condition: str) -> DataFrame:
    """The data with a flag for rows that meet a condition in Spark SQL; window functions are allowed, as they are not in a WHERE."""
    return data.select("*", F.coalesce(F.expr(f"({condition})").cast("boolean"), F.lit(False)).alias(_HIT))


def matching(data: DataFrame, condition: str) -> DataFrame:
    """Rows that meet a condition; windows in it that would gather a key or the table are computed apart."""
    data, condition, more = spread_windows(data, condition, ROW)
    return with_hit(data, condition).filter(_HIT).drop(_HIT, *more)


def repeated(data: DataFrame, column: str) -> DataFrame:
    """Rows whose value of a column another row has too.

    Values are counted first, with partial counts on the map side, and only those that
    repeat are joined back, where a window would sort and hold all rows of a value.
    """
    often = data.filter(F.col(quote(column)).isNotNull()).groupBy(F.col(quote(column)).alias("__value")).agg(F.count("*").alias("__n")).filter("__n > 1")
    return data.join(often.select("__value"), F.col(quote(column)) == F.col("__value"), "left_semi")


def out_of_order(data: DataFrame, column: str, direction: str, row_id: str = ROW) -> DataFrame:
    """Rows that break the order of the row before, by row id.

    Row ids are dense, so the row before is found by a join on the id less one; there
    is no window over the whole table.
    """
    before = data.select((F.col(row_id) + 1).alias("__at"), F.col(quote(column)).alias("__before"))
    joined = data.join(before, F.col(row_id) == F.col("__at"))
    return joined.filter(F.expr(f"{quote(column)} {DIRECTIONS[direction]} `__before`")).drop("__at", "__before")


def assertion_rows(data: DataFrame, assertion: Assertion | str, column: str) -> DataFrame:
    """Rows that break an assertion on a column."""
    a = parse_assertion(assertion) if isinstance(assertion, str) else assertion
    if a.name == "unique":
        return repeated(data, column)
    if a.name == "monotonic" and not a.named and ROW in data.columns:
        return out_of_order(data, column, str(a.positional[0].value).lower())
    return matching(data, violation(a, column))


def distinct_count(data: DataFrame, column: str) -> DataFrame:
    return data.agg(F.count_distinct(F.col(quote(column))).alias("n"))


@dataclass(frozen=True)
class Replacement:
    """Where ``condition`` holds, ``column`` gets ``expression``; both in Spark SQL."""

    column: str
    condition: str
    expression: str


def _changes(data: DataFrame, replacements: list[Replacement]) -> tuple[DataFrame, list[tuple[str, str, str]]]:
    names = []
    columns: list[Column] = []
    for i, r in enumerate(replacements):
        hit, after = f"__hit_{i}", f"__after_{i}"
        met = F.coalesce(F.expr(f"({r.condition})").cast("boolean"), F.lit(False))
        columns += [met.alias(hit), F.expr(f"CASE WHEN ({r.condition}) THEN ({r.expression}) ELSE {quote(r.column)} END").alias(after)]
        names.append((r.column, hit, after))
    return data.select("*", *columns), names


def replaced_cells(replacements: Sequence[Replacement]) -> list[Column]:
    """For each replacement (before, after) of the cell, or null where it stays."""
    cells = []
    for r in replacements:
        after = F.expr(f"CASE WHEN ({r.condition}) THEN ({r.expression}) ELSE {quote(r.column)} END")
        hit = F.coalesce(F.expr(f"({r.condition})").cast("boolean"), F.lit(False))
        cells.append(F.when(hit & ~F.col(quote(r.column)).eqNullSafe(after), F.struct(F.col(quote(r.column)).alias("before"), after.alias("after"))))
    return cells


def correct(data: DataFrame, replacements: list[Replacement]) -> DataFrame:
    """All replacements at once, each on the state before any of them."""
    return data.withColumns({r.column: F.expr(f"CASE WHEN ({r.condition}) THEN ({r.expression}) ELSE {quote(r.column)} END") for r in replacements})


def change_log(data: DataFrame, replacements: list[Replacement], row_id: str = ROW) -> DataFrame:
    """(row, target, column, before, after) of every cell that a correction changes, as text; target counts the replacements."""
    work, names = _changes(data, replacements)
    cells = F.array(*[
        F.when(
            F.col(hit) & ~F.col(quote(c)).eqNullSafe(F.col(after)),
            F.struct(F.lit(i).alias("target"), F.lit(c).alias("column"), F.col(quote(c)).cast("string").alias("before"), F.col(after).cast("string").alias("after")),
        )
        for i, (c, hit, after) in enumerate(names)
    ])
    return work.select(F.col(row_id).alias("row"), F.explode(F.filter(cells, lambda x: x.isNotNull())).alias("cell")).select("row", "cell.*")


def cell_changes(data: DataFrame, r: Replacement, row_id: str = ROW) -> DataFrame:
    """(row, before, after) of the cells that one replacement changes, in their own types."""
    work, [(column, hit, after)] = _changes(data, [r])
    changed = F.col(hit) & ~F.col(quote(column)).eqNullSafe(F.col(after))
    return work.filter(changed).select(F.col(row_id).alias("row"), F.col(quote(column)).alias("before"), F.col(after).alias("after"))


def change_counts(data: DataFrame, replacements: list[Replacement]) -> DataFrame:
    """One row: the number of changed cells of each replacement, n_0, n_1, ...; every new value is computed, so a failing one fails here."""
    work, names = _changes(data, replacements)
    changed = [F.count_if(F.col(hit) & ~F.col(quote(c)).eqNullSafe(F.col(after))).alias(f"n_{i}") for i, (c, hit, after) in enumerate(names)]
    return work.agg(*changed, *[F.count(after).alias(f"c_{i}") for i, (_, _, after) in enumerate(names)])


def duplicate_records(data: DataFrame, columns: list[str], row_id: str = ROW) -> DataFrame:
    """(first, other): for records equal in all columns, the first row and each later one.

    Records meet by a hash and the values; the first row of each is found with
    partial aggregates and joined back, so no group is gathered.
    """
    values = F.struct(*[F.to_json(F.struct(quote(c))).alias(c) if data.schema[c].dataType.typeName() == "map" else F.col(quote(c)).alias(c) for c in columns])
    keyed = data.select(F.col(row_id).alias("other"), values.alias("record"), F.xxhash64(values).alias("hash"))
    groups = keyed.groupBy("hash", "record").agg(F.min("other").alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = groups.select(F.col("hash").alias("h"), F.col("record").alias("r"), "first")
    on = (F.col("hash") == F.col("h")) & F.col("record").eqNullSafe(F.col("r"))
    return keyed.join(groups, on).filter("other <> first").select("first", "other")


# Casts are SQL text: a dataset has hundreds of columns, and the engine parses a text at once.
# A pattern comes before each cast, as a cast that fails is slow.


def integer_sql(text: str) -> str:
    """SQL for a text as a whole number: what reads as an integer, or as a finite double without a fraction; else null."""
    number = double_sql(text)
    long = f"CASE WHEN {text} RLIKE '^\\\\s*[+-]?[0-9]+\\\\s*$' THEN try_cast({text} AS BIGINT) END"
    return (
        f"CASE WHEN {text} RLIKE '^[+-]?[0-9]{{1,18}}$' THEN CAST({text} AS BIGINT) "
        f"WHEN {text} RLIKE '[0-9]' AND rint({number}) = {number} AND abs({number}) < double('Infinity') THEN coalesce({long}, CASE WHEN abs({number}) < 9.2e18D THEN CAST({number} AS BIGINT) END) END"
    )


def double_sql(text: str) -> str:
    """SQL for a text as a double, without the suffixes that Spark alone reads."""
    form = r"^\\s*[+-]?((\\d+[.]?\\d*|[.]\\d+)([eE][+-]?\\d+)?|[iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])\\s*$"
    return f"CASE WHEN {text} RLIKE '{form}' THEN try_cast(trim({text}) AS DOUBLE) END"


def integer_ladder(name: str) -> Column:
    """The same for a column by its name."""
    return F.expr(integer_sql(quote(name)))


def guarded_double(name: str) -> Column:
    return F.expr(double_sql(quote(name)))
