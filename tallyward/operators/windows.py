"""Windows that the engine would put into one task, or one row, computed apart and joined back.

Conditions of rules are SQL, and authors ask for windows in them. Four kinds do not scale as
they stand: an exact percentile of a key holds all values of the key; a count of distinct values holds
them in a set; and a window without partitions puts the table into one task. ``spread_windows``
finds these in a condition, computes each with partial aggregates, ranges and joins, and puts a
column in its place. Any other window stays as it is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyward.functions.sqltext import quote
from tallyward.operators.ordered import BLOCK, numbered, placed

_NAME = r"(?:`(?:[^`]|``)+`|[A-Za-z_][A-Za-z0-9_]*)"
_NAMES = rf"{_NAME}(?:\s*,\s*{_NAME})*"
_KEYS = re.compile(rf"\(\s*PARTITION\s+BY\s+({_NAMES})\s*\)", re.IGNORECASE)
_ORDER = re.compile(rf"\(\s*ORDER\s+BY\s+({_NAME})(?:\s+(ASC|DESC))?\s*(ROWS\s+(?:UNBOUNDED\s+PRECEDING|BETWEEN\s+UNBOUNDED\s+PRECEDING\s+AND\s+CURRENT\s+ROW))?\s*\)", re.IGNORECASE)
_CALL = re.compile(r"([A-Za-z_][A-Za-z0-9_]*)\s*\(")
_RUNNING = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class _Found:
    """A window in a text: where it stands, the function, its arguments, and what is in the brackets of OVER."""

    start: int
    end: int
    function: str
    arguments: list[str]
    over: str
    #: it is the argument of size(), as counts of distinct values are written
    sized: bool


def _closing(sql: str, at: int) -> int:
    """Place behind the bracket that closes the one at ``at``; texts and quoted names are skipped. -1: there is none."""
    depth, quoted, i = 0, "", at
    while i < len(sql):
        c = sql[i]
        if quoted:
            if c == "\\" and quoted != "`":
                i += 1
            elif c == quoted:
                quoted = ""
        elif c in "'\"`":
            quoted = c
        else:
            depth += (c in "([") - (c in ")]")
            if depth == 0:
                return i + 1
        i += 1
    return -1


def _arguments(body: str) -> list[str]:
    parts, start, i = [], 0, 0
    while i < len(body):
        if body[i] in "([":
            i = max(_closing(body, i), i + 1)
            continue
        if body[i] in "'\"`":
            end = body.find(body[i], i + 1)
            i = len(body) if end < 0 else end + 1
            continue
        if body[i] == ",":
            parts.append(body[start:i].strip())
            start = i + 1
        i += 1
    return [*parts, body[start:].strip()] if body.strip() else []


def _windows(sql: str) -> list[_Found]:
    """Calls with OVER, outside of texts."""
    out, at = [], 0
    bare = re.sub(r"'(?:[^'\\]|\\.)*'", lambda m: "'" + "x" * (len(m[0]) - 2) + "'", sql)
    while (call := _CALL.search(bare, at)) is not None:
        at = call.end()
        close = _closing(bare, call.end() - 1)
        over = re.compile(r"\s*OVER\s*(?=\()", re.IGNORECASE).match(bare, close) if close > 0 else None
        if over is None:
            continue
        end = _closing(bare, over.end())
        if end > 0:
            out.append(_Found(call.start(), end, call[1].lower(), _arguments(sql[call.end() : close - 1]), sql[over.end() : end], bool(re.search(r"\bsize\s*\(\s*$", bare[: call.start()])) and bare[end:].lstrip()[:1] == ")"))
            at = end
    return out


def _plain(name: str) -> str:
    return name[1:-1].replace("``", "`") if name.startswith("`") else name


def percentiles(data: DataFrame, keys: list[str], value: Column, shares: list[float]) -> DataFrame:
    """Exact percentiles by linear interpolation for each key: the keys as k0, k1, ... and p0, p1, ...

    Equal values are counted first. The counts are put into an order of key and value, and each knows the ranks
    that it covers by a running total over ranges of that order; of a key, only the values around the wanted
    ranks go on. Nulls and keys without a value have no rank.
    """
    names = [f"k{i}" for i in range(len(keys))]
    by = names or ["k"]
    own = [F.col(quote(k)).alias(n) for k, n in zip(keys, names)] or [F.lit(0).alias("k")]
    rows = data.select(*own, value.cast("double").alias("v")).where("v IS NOT NULL")
    counted = rows.groupBy(*by, "v").agg(F.count("*").alias("n"))
    ranked = placed(counted, *by, "v", weight="n", name="start")
    totals = ranked.groupBy(*[F.col(n).alias(f"_{n}") for n in by]).agg(F.sum("n").alias("total"), F.min("start").alias("base"))
    on = F.lit(True)
    for n in by:
        on = on & F.col(n).eqNullSafe(F.col(f"_{n}"))
    own = ranked.join(totals, on)
    first = F.col("start") - F.col("base")
    columns = []
    for i, p in enumerate(shares):
        at = F.lit(float(p)) * (F.col("total") - 1)
        for edge, of in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            columns.append(F.max(F.when((of >= first) & (of < first + F.col("n")), F.col("v"))).alias(f"{edge}{i}"))
        columns.append(F.max(at).alias(f"at{i}"))
    found = own.groupBy(*by).agg(*columns)
    between = [F.expr(f"CASE WHEN lo{i} = hi{i} THEN lo{i} ELSE (ceil(at{i}) - at{i}) * lo{i} + (at{i} - floor(at{i})) * hi{i} END").alias(f"p{i}") for i in range(len(shares))]
    return found.select(*names, *between)


def _joined_by(data: DataFrame, found: DataFrame, keys: list[str], column: str, value: str) -> DataFrame:
    """data with a column of a small or large table of one row for each combination of keys."""
    named = found.select(*[F.col(f"k{i}").alias(f"{column}k{i}") for i in range(len(keys))], F.col(value).alias(column))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(quote(k)).eqNullSafe(F.col(f"{column}k{i}"))
    return data.join(named, on, "left").drop(*[f"{column}k{i}" for i in range(len(keys))])


def distinct_counts(data: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """k0, k1, ..., n: how many distinct values that are not null each key has, from distinct pairs."""
    names = [f"k{i}" for i in range(len(keys))]
    pairs = data.select(*[F.col(quote(k)).alias(n) for k, n in zip(keys, names)], value.alias("v")).distinct()
    return pairs.groupBy(*names).agg(F.count("v").cast("int").alias("n"))


def shifted(data: DataFrame, order: list[Column], value: Column, steps: int, column: str) -> DataFrame:
    """data with the value of the row ``steps`` before in an order (behind, if negative), without one task for all rows.

    Places are cut into blocks; the rows next to a border stand in the neighbouring block as well, where
    they are looked at and then left out.
    """
    reach = max(1, abs(steps))
    size = max(BLOCK, reach)
    rows = numbered(data.withColumn("__v", value), *order, name="__place").withColumn("__block", F.floor(F.col("__place") / size))
    inside = F.col("__place") % size
    guest = F.when(inside >= size - reach, F.col("__block") + 1) if steps > 0 else F.when((inside < reach) & (F.col("__block") > 0), F.col("__block") - 1)
    both = rows.withColumn("__in", F.explode(F.array_compact(F.array(F.col("__block"), guest))))
    window = Window.partitionBy("__in").orderBy("__place")
    moved = F.lag("__v", steps).over(window) if steps >= 0 else F.lead("__v", -steps).over(window)
    return both.withColumn(column, moved).where("__in = __block").drop("__v", "__place", "__block", "__in")


def running(data: DataFrame, order: list[Column], function: str, value: Column, column: str) -> DataFrame:
    """data with sum, count, min or max of all rows up to each one in an order, from blocks and the totals before them."""
    held = F.when(value.isNotNull(), 1).otherwise(0).cast("long") if function == "count" else value
    rows = numbered(data.withColumn("__v", held), *order, name="__place").withColumn("__block", F.floor(F.col("__place") / BLOCK))
    f = _RUNNING[function]
    totals = rows.groupBy("__block").agg(f("__v").alias("t"))
    before = F.when(F.lit(True), f("t").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each block
    totals = totals.select(F.col("__block").alias("__b"), before.alias("__before"))
    here = f("__v").over(Window.partitionBy("__block").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__here", here).join(totals, F.col("__block") == F.col("__b"))
    if function in ("sum", "count"):
        both = F.when(F.col("__here").isNull(), F.col("__before")).when(F.col("__before").isNull(), F.col("__here")).otherwise(F.col("__here") + F.col("__before"))
    else:
        both = (F.least if function == "min" else F.greatest)("__here", "__before")
    return rows.withColumn(column, both).drop("__v", "__place", "__block", "__b", "__here", "__before")


def spread_windows(data: DataFrame, condition: str, row_id: str = "__row__") -> tuple[DataFrame, str, list[str]]:
    """data with a column for each window that can be computed apart, the condition with those columns, and their names.

    Ties in the order of a window without partitions are settled by the row id, if there is one.
    """
    names: dict[tuple[str, ...], str] = {}
    for w in reversed(_windows(condition)):
        key = (w.function, *w.arguments, w.over)
        if key not in names:
            column = f"__window_{len(names)}"
            more = _spread(data, w, column, row_id)
            if more is None:
                continue
            data, names[key] = more, column
        start, end = w.start, w.end
        if w.function == "collect_set":
            inside = re.compile(r"size\s*\(\s*$").search(condition[:start])
            start, end = inside.start(), condition.index(")", end) + 1
        condition = condition[:start] + quote(names[key]) + condition[end:]
    return data, condition, list(names.values())


def _spread(data: DataFrame, w: _Found, column: str, row_id: str) -> DataFrame | None:
    keyed, ordered = _KEYS.fullmatch(w.over), _ORDER.fullmatch(w.over)
    columns = {c.lower(): c for c in data.columns}
    if keyed:
        keys = [_plain(k.strip()) for k in re.findall(_NAME, keyed[1])]
        if any(k.lower() not in columns for k in keys):
            return None
        if w.function == "percentile" and len(w.arguments) == 2 and re.fullmatch(r"0(?:\.\d+)?|1(?:\.0*)?|\.\d+", w.arguments[1]):
            found = percentiles(data, keys, F.expr(w.arguments[0]), [float(w.arguments[1])])
            return _joined_by(data, found, keys, column, "p0")
        if w.function == "collect_set" and len(w.arguments) == 1:
            return _joined_by(data, distinct_counts(data, keys, F.expr(w.arguments[0])), keys, column, "n") if w.sized else None
        return None
    if not ordered or _plain(ordered[1]).lower() not in columns:
        return None
    by = F.col(quote(_plain(ordered[1])))
    order = [by.desc() if (ordered[2] or "").upper() == "DESC" else by.asc(), *([F.col(row_id)] if row_id in data.columns else [])]
    if w.function in ("lag", "lead") and not ordered[3] and 1 <= len(w.arguments) <= 2 and (len(w.arguments) == 1 or w.arguments[1].isdigit()):
        steps = int(w.arguments[1]) if len(w.arguments) == 2 else 1
        return shifted(data, order, F.expr(w.arguments[0]), steps if w.function == "lag" else -steps, column)
    if w.function == "row_number" and not w.arguments:
        return numbered(data, *order, name=column).withColumn(column, (F.col(column) + 1).cast("int"))
    if w.function in _RUNNING and ordered[3] and len(w.arguments) == 1:
        value = F.lit(1) if w.arguments[0] == "*" else F.expr(w.arguments[0])
        return running(data, order, w.function, value, column)
    return None
