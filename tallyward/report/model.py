"""The layout of a report: five sheets, without any formatting of files."""

from __future__ import annotations

import datetime as dt
import re
from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.plans.engine import RuleStat
from tallyward.plans.flags import RANK, Flag, FlagStore, flag_text
from tallyward.plans.rules import RuleFile
from tallyward.schema.digest import Digest, missing_columns
from tallyward.schema.run import SchemaSummary
from tallyward.sources.xlsx import MAX_CHARS, MAX_ROWS

CELL_FLAGS = 8
# Words for what became of a rule.
STATUS_WORDS = {
    "ok": "ok",
    "broken": "failed to execute",
    "skipped-disabled": "skipped — disabled",
    "skipped-external": "not evaluated — requires external reference data",
    "skipped-inapplicable": "skipped — target variables not in this dataset",
}


@dataclass
class DataSheet:
    #: (header, kind, source column, fill): kind is row-review, source or review
    columns: list[tuple[str, str, str | None, str | None]]
    #: row: column: (text, fill)
    cells: dict[int, dict[str, tuple[str, str]]]
    row_reviews: dict[int, str]
    row_limit: int
    truncated: bool
    note: str | None


@dataclass
class Report:
    data: DataSheet
    missing: list[tuple[str, str, str, str, bool]]
    missing_note: str | None
    findings: list[tuple[str, str, str, str, str, str, str]]
    offenders: list[tuple[str, str, str, str, int, str, str]]
    info: list[tuple[str, str]]
    file_name: str


@dataclass
class RunInfo:
    version: str
    at: dt.datetime
    dataset: str
    format: str
    schema_files: list[str] = field(default_factory=list)
    schema_root: str | None = None
    index_id: str | None = None
    rule_files: list[tuple[str, int]] = field(default_factory=list)
    durations: list[tuple[str, float]] = field(default_factory=list)
    corrections_applied: bool = True
    caps: list[tuple[str, str]] = field(default_factory=list)
    stage_errors: list[tuple[str, str]] = field(default_factory=list)


def fill(flags: Sequence[Flag]) -> str:
    if all(f.correction is not None for f in flags):
        return "corrected"
    return min((f.severity for f in flags), key=RANK.__getitem__)


def merged(flags: Sequence[Flag]) -> str:
    texts = [flag_text(f) for f in flags]
    text = "; ".join(texts[:CELL_FLAGS]) + (f" (+{len(texts) - CELL_FLAGS} more)" if len(texts) > CELL_FLAGS else "")
    mark = "… (truncated)"
    return text if len(text) <= MAX_CHARS else text[: MAX_CHARS - len(mark)] + mark


def free_name(base: str, taken: set[str]) -> str:
    name, k = base, 2
    while name in taken:
        name, k = f"{base}_{k}", k + 1
    taken.add(name)
    return name


def data_sheet(store: FlagStore, columns: Sequence[str], row_count: int) -> DataSheet:
    cells: dict[int, dict[str, list[Flag]]] = defaultdict(lambda: defaultdict(list))
    rows: dict[int, list[Flag]] = defaultdict(list)
    heads: dict[str, str] = {}
    reviewed = set()
    for f in store.flags():
        if f.scope == "cell" and f.column is not None and f.row is not None:
            reviewed.add(f.column)
            cells[f.row][f.column].append(f)
        elif f.scope == "row" and f.row is not None:
            rows[f.row].append(f)
        elif f.scope == "column" and f.column is not None and (f.column not in heads or RANK[f.severity] < RANK[heads[f.column]]):
            heads[f.column] = f.severity
    taken = set(columns)
    out = [(free_name("__row_review", taken), "row-review", None, None)] if rows else []
    for c in columns:
        out.append((c, "source", c, heads.get(c)))
        if c in reviewed:
            out.append((free_name(f"{c}__review", taken), "review", c, None))
    limit = min(row_count, MAX_ROWS)
    note = f"… {row_count - limit:,} more rows not shown — Excel caps a sheet at {MAX_ROWS:,} data rows. See the Run Info sheet." if row_count > limit else None
    return DataSheet(out, {r: {c: (merged(fs), fill(fs)) for c, fs in by.items()} for r, by in cells.items()}, {r: merged(fs) for r, fs in rows.items()}, limit, row_count > limit, note)


def exact_counts(stats: Sequence[RuleStat], schema: SchemaSummary | None) -> dict[str, int]:
    return {s.rule_id: s.violation_count for s in stats} | (schema.counts if schema else {})


def schema_targets(rule_id: str) -> str:
    parts = rule_id.split(":")
    place = {"prop": 2, "column": 2, "cond": 3}.get(parts[1] if len(parts) > 1 else "", 99)
    return parts[place] if place < len(parts) else "—"


def file_name(dataset: str, at: dt.datetime, prefix: str = "tallyward-report") -> str:
    stem = re.sub(r"[^\w.-]+", "_", re.sub(r"\.[^./\\]+\Z", "", dataset)) or "dataset"
    return f"{prefix}_{stem}_{at:%Y%m%d-%H%M}.xlsx"


def _duration(ms: float) -> str:
    return f"{ms / 1000:.1f} s" if ms >= 1000 else f"{round(ms)} ms"


def build_report(store: FlagStore, columns: Sequence[str], row_count: int, found: Digest | None, files: Sequence[RuleFile], stats: Sequence[RuleStat], corrected: int, aborted: bool, schema: SchemaSummary | None, info: RunInfo) -> Report:
    data = data_sheet(store, columns, row_count)
    exact = exact_counts(stats, schema)
    rules = {r.rule_id: r for f in files for r in f.rules}
    missing = [(c.name, c.title or "", c.description or "", c.group or "", c.required) for c in missing_columns(found.columns, list(columns))] if found else []
    findings = [(f.rule_id, f.source, f.severity, f.scope, f.column or "", f.message, str(exact.get(f.rule_id, n))) for f, n in [*store.dataset_scope(), *((f, n) for f, n in store.all() if f.scope == "column")]]
    for s in stats:
        if s.status != "ok":
            text = f"Rule failed to execute: {s.error or 'unknown error'}" if s.status == "broken" else STATUS_WORDS[s.status]
            findings.append((s.rule_id, "rules", "error" if s.status == "broken" else "info", "", "", text, ""))
    findings.sort(key=lambda r: RANK[r[2]])
    summary = store.summary()
    offenders = []
    for a in sorted(summary.per_rule, key=lambda a: (-exact.get(a.rule_id, a.count), a.rule_id)):
        rule = rules.get(a.rule_id)
        targets = ", ".join(rule.targets if rule else ()) if a.source == "rules" else schema_targets(a.rule_id)
        share = a.share(row_count)
        offenders.append((a.rule_id, a.source, a.severity, targets or "—", exact.get(a.rule_id, a.count), "—" if share is None else f"{100 * share:.1f}%", rule.comment if rule else ""))
    rows: list[tuple[str, str]] = [("Version", info.version), ("Run at", info.at.isoformat()), ("Dataset", f"{info.dataset} ({info.format})"), ("Rows", f"{row_count:,}"), ("Columns", f"{len(columns):,}"), ("", "")]
    rows.append(("Schema files", str(len(info.schema_files)) if info.schema_files else "(none)"))
    rows += [("  •", n) for n in info.schema_files]
    rows += [("  root", info.schema_root)] if info.schema_root else []
    rows += [("  index id", info.index_id)] if info.index_id else []
    rows += [("", ""), ("Rules files", str(len(info.rule_files)) if info.rule_files else "(none)")]
    rows += [("  •", f"{n} — {k:,} rules") for n, k in info.rule_files]
    rows += [("", ""), ("Corrections", "applied" if info.corrections_applied else "not applied (assess-only)"), ("Cells corrected", f"{corrected:,}")]
    rows += [("", ""), ("Stage durations", ""), *[(f"  {stage}", _duration(ms)) for stage, ms in info.durations]]
    if info.caps:
        rows += [("", ""), ("Caps in effect", ""), *[(f"  {k}", v) for k, v in info.caps]]
    notes = ["Data sheet truncated to Excel’s row limit."] * data.truncated + ["Flag materialization hit the global cap (exact counts unaffected)."] * summary.truncated
    notes += ["Run was cancelled — results are partial."] * aborted + [f"Stage {s} error: {m}" for s, m in info.stage_errors]
    if notes:
        rows += [("", ""), ("Notes", ""), *[("  •", n) for n in notes]]
    note = None if found else "No JSON Schema was loaded for this run — schema-vs-dataset comparison was not performed."
    return Report(data, missing, note, findings, offenders, rows, file_name(info.dataset, info.at))


def review_cells(findings: DataFrame, cap: int = CELL_FLAGS) -> DataFrame:
    """(row, column, review) of a table of findings (row, column, rule_id, message, seq), as a plan: the first findings of each cell, joined."""
    items = F.sort_array(F.collect_list(F.struct("seq", F.concat_ws(": ", "rule_id", "message").alias("text"))))
    cells = findings.groupBy("row", "column").agg(items.alias("items"))
    text = F.concat_ws("; ", F.transform(F.slice("items", 1, cap), lambda x: x["text"]))
    more = F.when(F.size("items") > cap, F.concat(F.lit(" (+"), (F.size("items") - cap).cast("string"), F.lit(" more)"))).otherwise("")
    return cells.select("row", "column", F.concat(text, more).alias("review"))
