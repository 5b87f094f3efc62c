"""Findings: single flags, their text, and a store that groups, counts and caps them."""

from __future__ import annotations

import datetime as dt
import decimal
import json
import math
from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Order of severities, and of the steps that a flag of a row can come from.
SEVERITIES = ("error", "warning", "info")
RANK = {s: i for i, s in enumerate(SEVERITIES)}
CORRECTION, SCHEMA, RULES = 0, 1, 2
FLAG_CAP = 200_000

FLAG_SCHEMA = (
    "source string, rule_id string, scope string, row long, column string, severity string, message string, value string, "
    "before string, after string, corrected boolean, keyword string, schema_path string, conditional_index int, category int, count long, seq long"
)


def number_text(v: float) -> str:
    """A number as its shortest text, whole ones without a point."""
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        if math.isinf(v):
            return "Infinity" if v > 0 else "-Infinity"
        if v.is_integer() and abs(v) < 1e21:
            return str(int(v))
        if 1e-6 <= abs(v) < 1e-4:
            return format(decimal.Decimal(repr(v)), "f")
        return repr(v).replace("e-0", "e-")
    return str(v)


def plain(v: Any) -> Any:
    """A value as JSON can hold it."""
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    if isinstance(v, (bytes, bytearray)):
        return v.hex()
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in v.items()}
    if hasattr(v, "asDict"):
        return {k: plain(x) for k, x in v.asDict().items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def value_text(v: Any) -> str:
    """A value inside a message: texts in quotes, nothing as null."""
    v = plain(v)
    if isinstance(v, str):
        return f"'{v}'"
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return number_text(v)
    return json.dumps(v, ensure_ascii=False, separators=(",", ":"))


@dataclass(frozen=True)
class Flag:
    source: str
    rule_id: str
    #: cell, row, column or dataset
    scope: str
    severity: str
    message: str
    row: int | None = None
    column: str | None = None
    value: Any = None
    #: (before, after) of a correction
    correction: tuple[Any, Any] | None = None
    keyword: str | None = None
    schema_path: str | None = None
    conditional_index: int | None = None

    @property
    def category(self) -> int:
        return CORRECTION if self.correction is not None else SCHEMA if self.source == "schema" else RULES


def message_text(flag: Flag) -> str:
    if flag.correction is None:
        return flag.message
    return f"{flag.message} (corrected: {value_text(flag.correction[0])} → {value_text(flag.correction[1])})"


def flag_text(flag: Flag) -> str:
    return f"{flag.rule_id}: {message_text(flag)}"


@dataclass
class Aggregate:
    rule_id: str
    source: str
    severity: str
    count: int = 0
    rows: set[int] = field(default_factory=set)

    def share(self, total: int | None) -> float | None:
        return len(self.rows) / total if total and self.rows else None


@dataclass
class StoreSummary:
    severity_totals: dict[str, int]
    per_rule: list[Aggregate]
    per_column: dict[str, int]
    rows_affected: int
    total: int
    truncated: bool


class FlagStore:
    """Flags by the order they came in; equal ones count once each time.

    Flags reach it under per-rule caps, so its size is bounded; totals are of flags
    that reached it, while exact counts of violations are with the rules. Beyond the
    cap the most severe stay, of equal severity the earliest.
    """

    def __init__(self, cap: int = FLAG_CAP):
        self.cap = cap
        self._entries: dict[tuple, list] = {}  # key: [flag, count, seq]
        self._seq = 0
        self._totals = dict.fromkeys(SEVERITIES, 0)
        self._rules: dict[str, Aggregate] = {}
        self._columns: dict[str, int] = defaultdict(int)
        self._rows: set[int] = set()

    def add(self, flags: Iterable[Flag]) -> None:
        for f in flags:
            self._totals[f.severity] += 1
            a = self._rules.setdefault(f.rule_id, Aggregate(f.rule_id, f.source, f.severity))
            a.count += 1
            if RANK[f.severity] < RANK[a.severity]:
                a.severity = f.severity
            if f.column is not None:
                self._columns[f.column] += 1
            if f.row is not None:
                a.rows.add(f.row)
                self._rows.add(f.row)
            key = (f.source, f.rule_id, f.scope, f.row, f.column, f.message)
            if key in self._entries:
                self._entries[key][1] += 1
            else:
                self._entries[key] = [f, 1, self._seq]
                self._seq += 1

    def add_counts(self, source: str, counts: dict[tuple[str, str, str | None], int]) -> None:
        """Count flags by (rule id, severity, column) that do not reach the store themselves."""
        for (rule_id, severity, column), n in counts.items():
            self._totals[severity] += n
            a = self._rules.setdefault(rule_id, Aggregate(rule_id, source, severity))
            a.count += n
            if RANK[severity] < RANK[a.severity]:
                a.severity = severity
            if column is not None:
                self._columns[column] += n

    def _kept(self) -> list[list]:
        if len(self._entries) <= self.cap:
            return list(self._entries.values())
        ranked = sorted(self._entries.values(), key=lambda e: (RANK[e[0].severity], e[2]))[: self.cap]
        return sorted(ranked, key=lambda e: e[2])

    def all(self) -> list[tuple[Flag, int]]:
        """(flag, times) by row, step, rule and arrival; flags without a row come first."""
        kept = sorted(self._kept(), key=lambda e: (-1 if e[0].row is None else e[0].row, e[0].category, e[0].rule_id, e[2]))
        return [(f, n) for f, n, _ in kept]

    def flags(self) -> list[Flag]:
        return [f for f, _ in self.all()]

    def by_cell(self, row: int, column: str) -> list[Flag]:
        return [f for f in self.flags() if f.row == row and f.column == column]

    def by_column(self, column: str) -> list[Flag]:
        return [f for f in self.flags() if f.column == column]

    def by_rule(self, rule_id: str) -> list[Flag]:
        return [f for f in self.flags() if f.rule_id == rule_id]

    def dataset_scope(self) -> list[tuple[Flag, int]]:
        return [(f, n) for f, n in self.all() if f.scope == "dataset"]

    def summary(self) -> StoreSummary:
        return StoreSummary(dict(self._totals), list(self._rules.values()), dict(self._columns), len(self._rows), sum(self._totals.values()), len(self._entries) > self.cap)

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        rows = []
        for seq, (f, n) in enumerate(self.all()):
            before, after = f.correction if f.correction else (None, None)
            text = lambda v: None if v is None else value_text(v)
            rows.append((f.source, f.rule_id, f.scope, f.row, f.column, f.severity, f.message, text(f.value), text(before), text(after), f.correction is not None, f.keyword, f.schema_path, f.conditional_index, f.category, n, seq))
        return spark.createDataFrame(rows, FLAG_SCHEMA)


def annotations(flags: Iterable[Flag], cap: int = 20_000) -> list[Flag]:
    """What a viewer paints: rows and columns first, then cells by severity, up to the cap of cells."""
    flags = list(flags)
    wide = [f for f in flags if f.scope in ("row", "column")]
    cells = sorted((f for f in flags if f.scope == "cell"), key=lambda f: RANK[f.severity])
    return wide + cells[:cap]
