"""Running rules: corrections in file order, then validations, with exact counts and capped findings.

The data is an immutable plan; a correction gives a new one. All conditions
without windows are counted in one pass, and the first violations of those that
have any are fetched in another. What comes to the driver is bounded by the
caps; counts are exact beyond them.
"""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.sandbox import CHUNK_MS, CHUNK_ROWS, MISSING, RULE_MS, Sandbox
from tallyward.functions.sqltext import put_value, quote, to_spark, tokenize
from tallyward.operators.assertions import parse_assertion, violation
from tallyward.operators.changelog import ChangeLog, step_rows
from tallyward.operators.checks import ROW, Replacement, assertion_rows, cell_changes, change_counts, change_log, correct, distinct_count, matching
from tallyward.plans.findings import Check, capped, extents
from tallyward.plans.flags import Flag, plain, value_text
from tallyward.plans.guard import check_query
from tallyward.plans.lint import error_line
from tallyward.plans.rules import Rule, RuleFile
from tallyward.plans.watch import Watch

_LOG = logging.getLogger(__name__)
ROW_CAP, DATASET_CAP, FLAG_CAP = 10_000, 200, 200_000
ERROR_SHARE, ERROR_FLAGS = 0.01, 50


@dataclass
class Options:
    row_cap: int = ROW_CAP
    dataset_cap: int = DATASET_CAP
    flag_cap: int = FLAG_CAP
    apply_corrections: bool = True
    sandboxes: dict[str, Sandbox] = field(default_factory=dict)
    chunk_ms: int = CHUNK_MS
    rule_ms: int = RULE_MS
    #: called as (rule id, index, total, phase) before each enabled rule
    on_progress: Callable[[str, int, int, str], None] | None = None
    on_flags: Callable[[list[Flag]], None] | None = None
    cancel: threading.Event | None = None
    #: called once with the corrected data, before the validations
    between: Callable[[DataFrame], None] | None = None
    #: lineage is cut to reliable storage after so many corrections, if spark.checkpoint.dir is set
    checkpoint_every: int = 8
    #: folder of the log of changes of this table: each correction is written there as a step, and a run that is begun
    #: again goes on behind the last step (row functions are applied again)
    change_log: str | None = None
    #: called from another thread with (tasks done, tasks in all) of the stages that run
    on_tasks: Callable[[int, int], None] | None = None

    @property
    def cancelled(self) -> bool:
        return self.cancel is not None and self.cancel.is_set()


@dataclass
class RuleStat:
    rule_id: str
    #: ok, broken, skipped-disabled, skipped-external or skipped-inapplicable
    status: str
    violation_count: int = 0
    flags_emitted: int = 0
    truncated: bool = False
    changed_cells: int | None = None
    duration_ms: float = 0.0
    error: str | None = None
    #: targets whose type a correction changed, as "column: before to after"
    retyped: tuple[str, ...] = ()


@dataclass
class RunResult:
    data: DataFrame
    flags: list[Flag]
    per_rule: list[RuleStat]
    corrected_cells: int
    aborted: bool


class _Sink:
    """Flags of the rule that is running, under the cap of the whole run; a broken rule's are taken back."""

    def __init__(self, cap: int, deliver: Callable[[list[Flag]], None] | None):
        self.cap, self.deliver = cap, deliver
        self.flags: list[Flag] = []
        self.admitted = 0
        self.discard()

    def emit(self, flag: Flag) -> None:
        if self.admitted + self.pending >= self.cap:
            self.suppressed += 1
        else:
            self.pending += 1
            self.buffer.append(flag)

    def summary(self, flag: Flag) -> None:
        self.buffer.append(flag)

    def flush(self) -> int:
        n = len(self.buffer)
        self.flags += self.buffer
        if n and self.deliver:
            self.deliver(self.buffer)
        self.admitted += self.pending
        self.discard()
        return n

    def discard(self) -> None:
        self.buffer: list[Flag] = []
        self.pending = self.suppressed = 0


def _has_window(sql: str) -> bool:
    return any(t.upper == "OVER" for t in tokenize(sql))


def conditions(rule: Rule) -> list[tuple[str, list[str]]]:
    """(violation condition in Spark SQL, targets) of a rule over rows; each with its own count."""
    if rule.rule_scope == "column":
        a = parse_assertion(rule.condition)
        return [(violation(a, t), [t]) for t in rule.distinct_targets]
    return [(to_spark(rule.condition), rule.distinct_targets)]


def violations(data: DataFrame, rule: Rule) -> list[tuple[DataFrame, list[str]]]:
    """(violating rows, targets) of a validating rule over rows, uncapped plans."""
    if rule.rule_scope == "column":
        a = parse_assertion(rule.condition)
        return [(assertion_rows(data, a, t), [t]) for t in rule.distinct_targets]
    condition = to_spark(rule.condition)
    check_query(data.sparkSession, f"SELECT ({condition}) FROM data")
    data.createOrReplaceTempView("data")
    return [(matching(data, condition), rule.distinct_targets)]


def replacements(rule: Rule) -> list[Replacement]:
    """What a SQL correction does, target by target; a target that is named twice cannot be replaced."""
    if len(rule.distinct_targets) != len(rule.targets):
        raise ValueError("a target is named twice")
    return [Replacement(t, to_spark(put_value(rule.condition, t)), to_spark(put_value(rule.update_expression, t))) for t in rule.targets]


def _counted(data: DataFrame, rules: Sequence[Rule], cap: int) -> tuple[list[Check], dict[str, tuple[int, int]]]:
    """Window-free rules as checks, and of each how many rows violate it and how far the first cap of them reach; all from one pass.

    A rule that cannot be counted so is left out, and counted for itself later.
    """
    own: list[Check] = []
    for r in rules:
        if r.rule_type != "validate" or r.rule_scope == "dataset" or not r.enabled or any(t not in data.columns for t in r.targets):
            continue
        try:
            if r.rule_scope == "column" and parse_assertion(r.condition).name in ("unique", "monotonic", "count_distinct_in_range"):
                continue
            found = conditions(r)
            for sql, _ in found:
                check_query(data.sparkSession, f"SELECT ({sql}) FROM data")
            if not any(_has_window(sql) or " (SELECT" in sql.upper() for sql, _ in found):
                own += [Check(f"{r.rule_id}|{i}", f"CAST(({sql}) AS BOOLEAN)", tuple(targets)) for i, (sql, targets) in enumerate(found)]
        except Exception as e:
            _LOG.info("rule %s is counted for itself: %s", r.rule_id, error_line(e))
    if not own or ROW not in data.columns:
        return [], {}
    try:
        got = {r["check"]: (r["n"], r["last"]) for r in extents(data, own, cap).collect()}  # a row for each check
    except Exception as e:
        _LOG.info("rules are counted one by one: %s", error_line(e))
        return [], {}
    return own, {c.key: got.get(i, (0, -1)) for i, c in enumerate(own)}


class _Run:
    def __init__(self, data: DataFrame, options: Options):
        self.data, self.options = data, options
        self.sink = _Sink(options.flag_cap, options.on_flags)
        self.stats: list[RuleStat] = []
        self.corrected = 0
        self.log = ChangeLog(data, options.change_log) if options.change_log else None

    def _retyped(self, before: DataFrame, rule: Rule) -> tuple[str, ...]:
        kinds = [(t, before.schema[t].dataType.simpleString(), self.data.schema[t].dataType.simpleString()) for t in rule.distinct_targets]
        return tuple(f"{t}: {old} to {new}" for t, old, new in kinds if old != new)

    def _guarded(self, rule: Rule, work: Callable[[Rule], tuple[int, bool]], correcting: bool) -> bool:
        """Run one rule; False if the run was cancelled meanwhile."""
        began = time.monotonic()
        before = self.data
        logged = len(self.log.steps) if self.log else 0
        try:
            count, truncated = work(rule)
            if self.options.cancelled:
                raise InterruptedError
            if self.sink.suppressed:
                truncated = True
                self.sink.summary(Flag("rules", rule.rule_id, "dataset", rule.severity, f"…and {self.sink.suppressed:,} more flags from this rule suppressed (global flag cap reached)"))
            emitted = self.sink.flush()
            self.stats.append(RuleStat(rule.rule_id, "ok", count, emitted, truncated, count if correcting else None, 1000 * (time.monotonic() - began), retyped=self._retyped(before, rule) if correcting else ()))
            self.corrected += count if correcting else 0
        except Exception as e:
            self.data = before
            if self.log:
                del self.log.steps[logged:]
            self.sink.discard()
            if self.options.cancelled:
                return False
            self.sink.summary(Flag("rules", rule.rule_id, "dataset", "error", f"Rule failed to execute: {error_line(e)}"))
            emitted = self.sink.flush()
            self.stats.append(RuleStat(rule.rule_id, "broken", 0, emitted, False, None, 1000 * (time.monotonic() - began), error_line(e)))
        return True

    def phase(self, rules: Sequence[Rule], name: str) -> None:
        correcting = name == "correct"
        own = [r for r in rules if r.rule_type == name]
        total, index = sum(r.enabled for r in own), 0
        self.checks, self.extents = ([], {}) if correcting else _counted(self.data, own, self.options.row_cap)
        self.fetched: dict[str, list] | None = None
        done = 0
        for rule in rules:
            if self.options.cancelled:
                return
            if rule.rule_type == "external" and not correcting:
                self.stats.append(RuleStat(rule.rule_id, "skipped-external"))
                continue
            if rule.rule_type != name:
                continue
            if not rule.enabled:
                self.stats.append(RuleStat(rule.rule_id, "skipped-disabled"))
                continue
            if self.options.on_progress:
                self.options.on_progress(rule.rule_id, index, total, name)
            index += 1
            if any(t not in self.data.columns for t in rule.targets):
                self.stats.append(RuleStat(rule.rule_id, "skipped-inapplicable"))
                continue
            if correcting:
                work = self.correct_rows if rule.update_language in ("js", "py") else self.correct_sql
            else:
                work = self.validate
            if not self._guarded(rule, work, correcting):
                return
            done += correcting
            if correcting and self.log is None and done % self.options.checkpoint_every == 0 and self.data.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
                self.data = self.data.checkpoint()

    # Validations

    def _first_rows(self, key: str, rows: DataFrame, targets: Sequence[str]) -> list[tuple]:
        """(row, values of the targets) of the first violations. Those of all rules counted together are fetched together, as far as the cap of the run goes."""
        if self.fetched is None:
            self.fetched, room, wanted = {}, self.options.flag_cap, []
            for c in self.checks:
                n = min(self.extents[c.key][0], self.options.row_cap)
                if n and n * len(c.targets) <= room:
                    room -= n * len(c.targets)
                    wanted.append(c)
            if wanted:
                spark = self.data.sparkSession
                reach = spark.createDataFrame([(i, self.extents[c.key][1]) for i, c in enumerate(wanted)], "check int, last long")
                try:
                    got = capped(self.data, wanted, self.options.row_cap, reach).collect()
                    self.fetched = {c.key: [] for c in wanted}
                except Exception as e:
                    _LOG.info("violations are fetched rule by rule: %s", error_line(e))
                    got = []
                for r in got:
                    c = wanted[r["check"]]
                    self.fetched[c.key].append((r["row"], *(r["cells"][t] for t in c.targets)))
        if key in self.fetched:
            return sorted(self.fetched[key], key=lambda r: r[0])
        return rows.select(ROW, *[quote(t) for t in targets]).orderBy(ROW).limit(self.options.row_cap).collect()

    def validate(self, rule: Rule) -> tuple[int, bool]:
        if rule.rule_scope == "dataset":
            return self.validate_dataset(rule)
        if rule.rule_scope == "column" and parse_assertion(rule.condition).name == "count_distinct_in_range":
            return self.validate_distinct(rule)
        total, truncated = 0, False
        cap = self.options.row_cap
        for i, (rows, targets) in enumerate(violations(self.data, rule)):
            key = f"{rule.rule_id}|{i}"
            n = self.extents[key][0] if key in self.extents else rows.count()
            total += n
            if not n:
                continue
            for r in self._first_rows(key, rows, targets):
                for j, t in enumerate(targets):
                    self.sink.emit(Flag("rules", rule.rule_id, "cell", rule.severity, rule.message, r[0], t, r[j + 1]))
            if n > cap:
                truncated = True
                for t in targets:
                    self.sink.summary(Flag("rules", rule.rule_id, "column", rule.severity, f"…and {n - cap:,} more rows flagged by this rule", column=t))
        return total, truncated

    def validate_distinct(self, rule: Rule) -> tuple[int, bool]:
        low, high = (float(a.value) for a in parse_assertion(rule.condition).positional)
        bad = 0
        for t in rule.distinct_targets:
            n = distinct_count(self.data, t).first()[0]
            if n < low or n > high:
                bad += 1
                self.sink.emit(Flag("rules", rule.rule_id, "column", rule.severity, f"{rule.message} Found {n} distinct values.", column=t))
        return bad, False

    def validate_dataset(self, rule: Rule) -> tuple[int, bool]:
        cap = self.options.dataset_cap
        found = dataset_query(self.data, rule)
        rows = found.limit(cap + 1).collect()
        for r in rows[:cap]:
            pairs = "; ".join(f"{k}={value_text(v)}" for k, v in zip(found.columns, r))
            self.sink.emit(Flag("rules", rule.rule_id, "dataset", rule.severity, f"{rule.message} — {pairs}"))
        if len(rows) <= cap:
            return len(rows), False
        n = found.count()
        self.sink.summary(Flag("rules", rule.rule_id, "dataset", rule.severity, f"…and {n - cap:,} more result rows"))
        return n, True

    # Corrections

    def _changes(self, rule: Rule, changes: Sequence[tuple[str, int, DataFrame]]) -> bool:
        """Flags for (target, number of changes, the changes)."""
        cap, truncated = self.options.row_cap, False
        for t, n, log in changes:
            if not n:
                continue
            for r in log.orderBy("row").limit(cap).collect():
                before, after = r["before"], r["after"]
                self.sink.emit(Flag("rules", rule.rule_id, "cell", rule.severity, rule.message, r["row"], t, before, (before, after)))
            if n > cap:
                truncated = True
                self.sink.summary(Flag("rules", rule.rule_id, "column", rule.severity, f"…and {n - cap:,} more rows corrected by this rule", column=t))
        return truncated

    def correct_sql(self, rule: Rule) -> tuple[int, bool]:
        own = replacements(rule)
        for r in own:
            check_query(self.data.sparkSession, f"SELECT ({r.condition}), ({r.expression}) FROM data")
        self.data.createOrReplaceTempView("data")
        if self.log is not None:
            step = self.log.record(repr(own), [r.column for r in own], lambda: step_rows(self.data, own))
            counts = step.counts()
            truncated = self._changes(rule, [(t, n, step.cells(i)) for i, (t, n) in enumerate(zip(step.targets, counts))])
            if sum(counts):
                self.data = self.log.merged()
            else:
                self.log.steps.pop()
            return sum(counts), truncated
        got = change_counts(self.data, own).first()
        counts = [got[f"n_{i}"] for i in range(len(own))]
        truncated = self._changes(rule, [(r.column, n, cell_changes(self.data, r)) for r, n in zip(own, counts)])
        if sum(counts):
            self.data = correct(self.data, own)
        return sum(counts), truncated

    def correct_rows(self, rule: Rule) -> tuple[int, bool]:
        sandbox = self.options.sandboxes.get(rule.update_language)
        if sandbox is None:
            raise RuntimeError(MISSING)
        updates, processed, errors = [], 0, []
        names = self.data.columns
        for t in rule.distinct_targets:
            condition = to_spark(put_value(rule.condition, t))
            check_query(self.data.sparkSession, f"SELECT ({condition}) FROM data")
            staged = _staged(matching(self.data, condition), names, t, rule.update_expression, sandbox, self.options)
            staged = staged.checkpoint() if staged.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else staged.persist()
            total = staged.agg(F.count("*"), F.count("error"), F.sum("ms")).first()
            processed += total[0]
            if total[1]:
                errors += [(t, r) for r in staged.filter("error is not null").orderBy("row").limit(ERROR_FLAGS + 1).collect()]
                if total[1] > processed * ERROR_SHARE:
                    raise RuntimeError(f"JS correction failed on {total[1]} of {processed} rows (over the 1% limit); first error: {errors[0][1]['error']}")
            updates.append((t, staged, total[1]))
        work, counts, logs = self.data, [], []
        kinds = {f.name: f.dataType for f in self.data.schema}
        for t, staged, _ in updates:
            own = staged.filter("changed").select(F.col("row").alias("__at"), F.col("val").cast(kinds[t]).alias("__val"), F.lit(True).alias("__set"))
            joined = work.join(own, F.col(ROW) == F.col("__at"), "left")
            hit = F.coalesce(F.col("__set"), F.lit(False)) & ~F.col(quote(t)).eqNullSafe(F.col("__val"))
            changes = self.data.join(own, F.col(ROW) == F.col("__at")).filter(hit).select(F.col(ROW).alias("row"), F.col(quote(t)).alias("before"), F.col("__val").alias("after"))
            counts.append(changes.count())
            logs.append((t, counts[-1], changes))
            work = joined.withColumn(t, F.when(F.col("__set"), F.col("__val")).otherwise(F.col(quote(t)))).select(*[quote(n) for n in names])
        truncated = self._changes(rule, logs)
        if sum(counts):
            self.data = work if self.log is None else self._log_rows(rule, logs)
        for t, r in errors[:ERROR_FLAGS]:
            self.sink.emit(Flag("rules", rule.rule_id, "cell", "warning", f"JS error on row {r['row']}: {r['error']}", r["row"], t))
        failed = sum(n for _, _, n in updates)
        if failed > ERROR_FLAGS:
            self.sink.summary(Flag("rules", rule.rule_id, "column", "warning", f"…and {failed - ERROR_FLAGS:,} more JS errors from this rule", column=errors[-1][0]))
        return sum(counts), truncated


    def _log_rows(self, rule: Rule, logs: Sequence[tuple[str, int, DataFrame]]) -> DataFrame:
        """The changes of a row function as steps, one for each target."""
        for t, _, changes in logs:
            rows = changes.select(F.col("row").alias(ROW), F.struct("before", "after").alias("c_0"))
            self.log.record(repr((t, rule.condition, rule.update_expression)), [t], lambda rows=rows: rows)
        return self.log.merged()


def dataset_query(data: DataFrame, rule: Rule) -> DataFrame:
    """The plan of a rule over the whole dataset; its SELECT may have a LIMIT of its own."""
    sql = to_spark(rule.condition)
    check_query(data.sparkSession, sql)
    data.createOrReplaceTempView("data")
    return data.sparkSession.sql(sql)


def _staged(hits: DataFrame, names: Sequence[str], target: str, source: str, sandbox: Sandbox, options: Options) -> DataFrame:
    """(row, val as text, changed, error, ms) for the rows that a row function is applied to."""
    chunk_ms, rule_ms = options.chunk_ms, options.rule_ms

    def text(v: Any) -> str | None:
        if v is None or isinstance(v, str):
            return v
        return value_text(v)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        spent = 0.0
        for frame in frames:
            for at in range(0, len(frame), CHUNK_ROWS):
                part = frame.iloc[at : at + CHUNK_ROWS]
                rows = [{k: None if v is None or v is pd.NaT or v != v else plain(v.item() if hasattr(v, "item") else v) for k, v in r.items()} for r in part.to_dict("records")]
                began = time.monotonic()
                got = sandbox.run(source, [(int(r[ROW]), r[target], r) for r in rows], chunk_ms)
                spent += 1000 * (time.monotonic() - began)
                if spent > rule_ms:
                    raise RuntimeError(f"JS correction exceeded the {rule_ms} ms per-rule sandbox budget")
                yield pd.DataFrame({"row": [o.row for o in got], "val": [text(o.value) for o in got], "changed": [o.changed for o in got], "error": [o.error for o in got], "ms": spent})

    return hits.select(*[quote(n) for n in names]).mapInPandas(run, "row long, val string, changed boolean, error string, ms double")


def run_rules(data: DataFrame, files: Sequence[RuleFile], options: Options | None = None) -> RunResult:
    """Corrections, then the hook between, then validations of the corrected data.

    Once `cancel` is set, the Spark job that runs is cancelled and its rule leaves nothing.
    """
    options = options or Options()
    run = _Run(data, options)
    rules = [r for f in files for r in f.rules]
    with Watch(data.sparkSession, options.cancel, options.on_tasks):
        try:
            if options.apply_corrections and not options.cancelled:
                run.phase(rules, "correct")
            if options.between and not options.cancelled:
                options.between(run.data)
            if not options.cancelled:
                run.phase(rules, "validate")
        except Exception:
            if not options.cancelled:  # else it is a job that was cancelled between two rules
                raise
    return RunResult(run.data, run.sink.flags, run.stats, run.corrected, options.cancelled)


@dataclass
class RuleTest:
    #: validate, assert, correct, dataset, not-testable or error
    kind: str
    count: int = 0
    sample: list[dict[str, Any]] = field(default_factory=list)
    error: str | None = None


def test_rule(data: DataFrame, rule: Rule, sample: int = 20, options: Options | None = None) -> RuleTest:
    """What a rule would do: an exact count and a few rows; the data stays as it is."""
    if rule.rule_type == "external":
        return RuleTest("not-testable")
    options = options or Options(row_cap=sample, dataset_cap=sample)
    file = RuleFile("test", "test", [rule])
    result = run_rules(data, [file], options)
    stat = result.per_rule[0] if result.per_rule else RuleStat(rule.rule_id, "broken", error="not run")
    if stat.status != "ok":
        return RuleTest("error", error=stat.error or stat.status)
    kind = "correct" if rule.rule_type == "correct" else {"column": "assert", "dataset": "dataset"}.get(rule.rule_scope, "validate")
    rows = [{"row": f.row, "column": f.column, "value": f.value, "correction": f.correction, "message": f.message} for f in result.flags if f.scope in ("cell", "dataset")]
    return RuleTest(kind, stat.violation_count, rows[:sample])


def rows_for_rule(data: DataFrame, rule: Rule) -> DataFrame | None:
    """The rows that a rule finds, as a plan, or None where a rule has no rows of its own."""
    if rule.rule_type == "external" or rule.rule_scope == "dataset" or any(t not in data.columns for t in rule.targets):
        return None
    if rule.rule_type == "correct":
        if rule.update_language != "sql":
            return None
        changed = change_log(data, replacements(rule)).select("row").distinct()
        return data.join(changed, F.col(ROW) == F.col("row"), "left_semi")
    if rule.rule_scope == "column" and parse_assertion(rule.condition).name == "count_distinct_in_range":
        return None
    found = None
    for rows, _ in violations(data, rule):
        found = rows.select(ROW) if found is None else found.unionByName(rows.select(ROW))
    return data.join(found.distinct(), ROW, "left_semi")
