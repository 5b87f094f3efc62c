"""A whole run: read, cast, correct, validate against the schema, validate against the rules, report."""

from __future__ import annotations

import datetime as dt
import json
import os
import threading
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from tallyward.functions.sandbox import NodeSandbox, PythonSandbox, Sandbox, SandboxError
from tallyward.operators.checks import ROW
from tallyward.plans.engine import Options, RuleStat, run_rules
from tallyward.plans.flags import FLAG_CAP, FlagStore
from tallyward.plans.lint import LintResult, excluded_ids, executable_file, lint_rules
from tallyward.plans.pertinence import CrossCheck, cross_check
from tallyward.plans.rules import RuleFile, parse_rules
from tallyward.report.model import Report, RunInfo, build_report
from tallyward.report.workbook import write_workbook
from tallyward.schema.digest import Digest, digest
from tallyward.schema.loader import SchemaSet, build_schema_set
from tallyward.schema.run import SchemaSummary, cast_plan, typed, validate_schema
from tallyward.storage import stored
from tallyward.sources.artifacts import fetch, read_rule_files, read_schema_entries
from tallyward.sources.dataset import Dataset, InputError, load_dataset

VERSION = "0.1.0"
SUMMARY_VERSION = 1
STAGES = ("prepare", "corrections", "schema", "rules", "annotate")
NO_CHECKS = "Provide a JSON Schema (--schema) or a QC rules file (--rules) — either is enough."


class RunError(Exception):
    """A run that ended early; kind is usage, input, schema, run or report."""

    def __init__(self, kind: str, message: str, detail: Sequence[str] = ()):
        super().__init__(message)
        self.kind, self.detail = kind, list(detail)


@dataclass
class Result:
    dataset: Dataset
    data: DataFrame
    store: FlagStore
    row_count: int
    per_rule: list[RuleStat]
    corrected_cells: int
    aborted: bool
    schemas: SchemaSet | None
    digest: Digest | None
    schema: SchemaSummary | None
    lint: list[LintResult]
    report: Report
    pertinence: CrossCheck
    corrections_applied: bool
    durations: dict[str, float] = field(default_factory=dict)
    stage_errors: list[tuple[str, str]] = field(default_factory=list)
    out_path: str | None = None

    def findings(self) -> DataFrame:
        return self.store.to_dataframe(self.data.sparkSession)

    def write_parquet(self, path: str) -> None:
        """The corrected data, without row ids."""
        self.data.drop(ROW).write.mode("overwrite").parquet(path)


def default_sandboxes() -> dict[str, Sandbox]:
    """Python expressions always; JavaScript where node is installed on driver and executors alike, if asked for."""
    found: dict[str, Sandbox] = {"py": PythonSandbox()}
    if os.environ.get("TALLYWARD_NODE"):
        try:
            found["js"] = NodeSandbox(os.environ["TALLYWARD_NODE"])
        except SandboxError:
            pass
    return found


def load_schema(paths: Sequence[str], index: str | None) -> tuple[SchemaSet, Digest]:
    try:
        origin, entries = read_schema_entries(paths)
    except InputError as e:
        raise RunError("input", str(e)) from e
    schemas = build_schema_set(entries, origin, index, fetch if origin == "url" else None)
    if schemas.fatal:
        raise RunError("schema", "The JSON Schema set could not be loaded.", [i.message for i in schemas.fatal])
    if schemas.root is None:
        several = len(schemas.candidates) > 1
        raise RunError("schema", "Several schema files could be the root — name one with --index." if several else "No root schema file could be identified in this set.", [" · ".join(x for x in (f.file_id, f.declared_id) if x) for f in schemas.candidates])
    found = digest(schemas)
    if found is None:
        raise RunError("schema", "The JSON Schema set produced no column information.")
    return schemas, found


def check(dataset: Dataset, schemas: SchemaSet | None = None, found: Digest | None = None, files: Sequence[RuleFile] = (), apply_corrections: bool = True, sandboxes: dict[str, Sandbox] | None = None, on_progress: Callable[[str, str], None] | None = None, cancel: threading.Event | None = None, info: RunInfo | None = None) -> Result:
    """A run over data that has been read; a stage that fails is noted and the next ones still run."""
    sandboxes = default_sandboxes() if sandboxes is None else sandboxes
    store = FlagStore()
    durations: dict[str, float] = {}
    errors: list[tuple[str, str]] = []
    say = on_progress or (lambda stage, text: None)
    raw = dataset.data
    began = time.monotonic()

    def timed(stage: str) -> None:
        nonlocal began
        durations[stage] = durations.get(stage, 0.0) + 1000 * (time.monotonic() - began)
        began = time.monotonic()

    say("prepare", "casting")
    data = plain = typed(raw, cast_plan(found.by_name, raw)) if found else raw
    lint = lint_rules(files, data, sandboxes)
    runnable = [f for f in (executable_file(f, r) for f, r in zip(files, lint)) if f is not None]
    if found is None and not any(f.rules for f in runnable):
        raise RunError("usage", NO_CHECKS if not files else "Every rule was excluded by lint errors, and no JSON Schema was provided — there is nothing to check.", [f"{i.file}: {i.message}" for r in lint for i in r.issues])
    row_count = raw.count()
    timed("prepare")
    summary: SchemaSummary | None = None
    ran = False

    def between(corrected: DataFrame) -> None:
        nonlocal summary, ran
        ran = True
        timed("corrections")
        if found is None or schemas is None:
            return
        say("schema", "validating rows")
        try:
            kept = None if corrected is plain else stored(corrected, "corrected")
            flags, summary = validate_schema(raw, kept, schemas, found)
            store.add(flags)
            store.add_counts("schema", summary.beyond)
        except Exception as e:
            errors.append(("schema", str(e).split("\n", 1)[0]))
        timed("schema")

    options = Options(apply_corrections=apply_corrections, sandboxes=sandboxes, cancel=cancel, between=between, on_flags=store.add, on_progress=lambda rule, i, n, phase: say("corrections" if phase == "correct" else "rules", f"{rule} ({i + 1} of {n})"))
    stats, corrected, aborted = [], 0, False
    try:
        result = run_rules(data, runnable, options)
        data, stats, corrected, aborted = result.data, result.per_rule, result.corrected_cells, result.aborted
    except Exception as e:
        errors.append(("rules", str(e).split("\n", 1)[0]))
        if not ran:
            between(data)
    timed("rules")
    say("annotate", "laying out the report")
    info = info or RunInfo(VERSION, dt.datetime.now(), dataset.name, dataset.format)
    info.corrections_applied = apply_corrections
    info.rule_files = [(f.name, len(f.rules)) for f in files]
    info.caps = [("Flags materialized", f"{FLAG_CAP:,}"), ("Cell annotations painted", f"{20_000:,}")]
    info.stage_errors = errors
    if schemas:
        info.schema_files, info.schema_root, info.index_id = [f.path for f in schemas.schemas], schemas.root.path, schemas.index_id
    timed("annotate")
    info.durations = [(s, durations[s]) for s in STAGES if s in durations]
    report = build_report(store, dataset.columns, row_count, found, files, stats, corrected, aborted, summary, info)
    targets = [t for f in runnable for r in f.rules if r.enabled and r.rule_type != "external" for t in r.targets]
    fit = cross_check(dataset.columns, [(c.name, c.required) for c in found.columns] if found else None, targets if runnable else None)
    return Result(dataset, data, store, row_count, stats, corrected, aborted, schemas, found, summary, lint, report, fit, apply_corrections, durations, errors)


def run_qc(spark: SparkSession, dataset: str, schema: Sequence[str] = (), rules: Sequence[str] = (), index: str | None = None, sheet: str | None = None, out: str | None = None, apply_corrections: bool = True, on_progress: Callable[[str, str], None] | None = None, cancel: threading.Event | None = None, sandboxes: dict[str, Sandbox] | None = None, workbook: bool = True) -> Result:
    """Check one dataset against schemas, rules or both, and write the report."""
    if not schema and not rules:
        raise RunError("usage", NO_CHECKS)
    try:
        texts = read_rule_files(rules)
        loaded = load_dataset(spark, dataset, sheet)
    except InputError as e:
        raise RunError("input", str(e)) from e
    schemas, found = load_schema(schema, index) if schema else (None, None)
    files = [parse_rules(text, name) for name, text in texts]
    result = check(loaded, schemas, found, files, apply_corrections, sandboxes, on_progress, cancel)
    if result.aborted:
        raise RunError("run", "The QC run was cancelled — no report was written.")
    if workbook:
        path = out or "."
        path = os.path.join(path, result.report.file_name) if os.path.isdir(path) else path
        try:
            write_workbook(path, result.report, result.data)
        except Exception as e:
            raise RunError("report", f"Could not write the QC report to '{path}'.") from e
        result.out_path = os.path.abspath(path)
    return result


def build_summary(result: Result, exit_code: int = 0, generated_at: str | None = None) -> dict[str, Any]:
    """The run in a machine-readable form; field names and version are fixed."""
    flags = result.store.summary()
    d, s = result.dataset, result.schemas
    return {
        "summarySchemaVersion": SUMMARY_VERSION,
        "toolVersion": VERSION,
        "generatedAt": generated_at or dt.datetime.now(dt.timezone.utc).isoformat(),
        "exitCode": exit_code,
        "dataset": {"path": d.path, "name": d.name, "format": d.format, "sheet": d.sheet, "rows": result.row_count, "columns": len(d.columns)},
        "inputs": {
            "schema": None if s is None else {"files": [f.path for f in s.schemas], "root": s.root.path if s.root else None, "index": s.index_id, "loadWarnings": [i.message for i in s.issues if i.severity != "fatal"]},
            "rules": [{"name": r.file, "rules": r.rule_count, "lintErrors": sum(i.severity == "error" for i in r.issues), "excludedRuleIds": excluded_ids(r)} for r in result.lint],
            "applyCorrections": result.corrections_applied,
        },
        "severityTotals": flags.severity_totals,
        "rowsAffected": max(flags.rows_affected, result.schema.rows_affected if result.schema else 0),
        "flagsTruncated": flags.truncated or bool(result.schema and result.schema.flags_truncated),
        "correctedCells": result.corrected_cells,
        "perRule": [{"ruleId": r.rule_id, "status": r.status, "violationCount": r.violation_count, "flagsEmitted": r.flags_emitted, "truncated": r.truncated, "durationMs": r.duration_ms} for r in result.per_rule],
        "schema": None if result.schema is None else {"rowsTotal": result.schema.rows_total, "rowsWithErrors": result.schema.rows_with_errors, "flagsEmitted": result.schema.flags_emitted, "flagsTruncated": result.schema.flags_truncated, "countsByRuleId": result.schema.counts, "elapsedMs": result.schema.elapsed_ms, "aborted": result.schema.aborted},
        "missingVariables": [{"name": r[0], "description": r[2]} for r in result.report.missing],
        "stageErrors": [{"stage": a, "message": b} for a, b in result.stage_errors],
        "durations": result.durations,
        "report": {"path": result.out_path, "dataRowsTruncated": result.report.data.truncated},
    }


@dataclass
class RunConfig:
    """Inputs of a run from a manifest or a query string; what is given directly wins, key by key."""

    schema: list[str] = field(default_factory=list)
    rules: list[str] = field(default_factory=list)
    index: str | None = None
    data: str | None = None

    @classmethod
    def from_manifest(cls, text: str, **direct: Any) -> RunConfig:
        doc = json.loads(text)
        if not isinstance(doc, dict):
            raise RunError("usage", "A configuration is a JSON object.")
        many = lambda v: [v] if isinstance(v, str) else list(v or [])
        merged = {k: doc.get(k) for k in ("schema", "rules", "index", "data")} | {k: v for k, v in direct.items() if v}
        return cls(many(merged["schema"]), many(merged["rules"]), merged["index"], merged["data"])

    @classmethod
    def from_query(cls, query: str, load: Callable[[str], str] | None = None) -> RunConfig:
        from urllib.parse import parse_qs

        found = parse_qs(query.removeprefix("?"))
        direct = {"schema": found.get("schema"), "rules": found.get("rules"), "index": (found.get("index") or [None])[0], "data": (found.get("data") or [None])[0]}
        if "config" in found and load is not None:
            return cls.from_manifest(load(found["config"][0]), **direct)
        return cls(direct["schema"] or [], direct["rules"] or [], direct["index"], direct["data"])

    def to_query(self, limit: int = 2000) -> str:
        from urllib.parse import urlencode

        pairs = [("schema", s) for s in self.schema] + [("rules", r) for r in self.rules] + [(k, v) for k, v in (("index", self.index), ("data", self.data)) if v]
        text = urlencode(pairs)
        if len(text) > limit:
            raise RunError("usage", f"The link would have {len(text):,} characters; the limit is {limit:,}. Use a configuration file.")
        return text
