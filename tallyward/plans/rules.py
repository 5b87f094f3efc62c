"""Rules, rule files (reading and writing) and books of rules."""

from __future__ import annotations

import csv
import dataclasses
import io
import re
from collections.abc import Iterable
from dataclasses import dataclass, field

# Columns of a rules file in order, those it must have, and the words its cells may hold.
COLUMNS = ("rule_id", "rule_type", "rule_scope", "target_variables", "condition", "update_language", "update_expression", "severity", "comment", "enabled")
REQUIRED = ("rule_id", "rule_type", "rule_scope", "target_variables", "condition", "comment")
TYPES = ("validate", "correct", "external")
SCOPES = ("row", "column", "dataset", "longitudinal")
LANGUAGES = ("sql", "js", "py")
SEVERITIES = ("error", "warning", "info")
_TRUE, _FALSE = ("true", "yes", "1"), ("false", "no", "0")


@dataclass(frozen=True)
class Rule:
    rule_id: str
    rule_type: str
    rule_scope: str
    targets: tuple[str, ...]
    condition: str
    update_language: str = "sql"
    update_expression: str = ""
    severity: str = "error"
    comment: str = ""
    enabled: bool = True
    source_file: str = ""
    row_number: int = 0
    extras: dict[str, str] = field(default_factory=dict)

    @property
    def distinct_targets(self) -> list[str]:
        return list(dict.fromkeys(self.targets))

    @property
    def message(self) -> str:
        return self.comment if self.comment.strip() else "Rule condition matched."


@dataclass(frozen=True)
class Issue:
    severity: str
    code: str
    file: str
    message: str
    rule_id: str | None = None
    row_number: int | None = None
    column: str | None = None
    detail: str | None = None


@dataclass
class RuleFile:
    name: str
    group: str
    rules: list[Rule]
    extra_columns: list[str] = field(default_factory=list)
    issues: list[Issue] = field(default_factory=list)
    headers: list[str] = field(default_factory=lambda: list(COLUMNS))


def group_of(name: str) -> str:
    base = re.split(r"[/\\]", name)[-1]
    return re.sub(r"(?i)(\.rules)?\.csv\Z", "", base)


def guess_delimiter(text: str) -> str:
    """The one of comma, semicolon and tab that most evenly splits the first records, preferring more columns."""
    best, score = ",", (-1.0, 0.0)
    for d in (",", ";", "\t"):
        rows = []
        try:
            for row in csv.reader(io.StringIO(text[:100_000], newline=""), delimiter=d):
                rows.append(len(row))
                if len(rows) >= 10:
                    break
        except csv.Error:
            continue
        rows = [n for n in rows if n > 0]
        if not rows or rows[0] < 2:
            continue
        even = sum(n == rows[0] for n in rows) / len(rows)
        if (even, rows[0]) > score:
            best, score = d, (even, rows[0])
    return best


def parse_rules(text: str, file_name: str) -> RuleFile:
    """A rules file; what is wrong with it becomes issues, never an exception."""
    name = re.split(r"[/\\]", file_name)[-1]
    group = group_of(name)
    text = text.removeprefix("﻿")
    csv.field_size_limit(1 << 30)
    records = list(csv.reader(io.StringIO(text, newline=""), delimiter=guess_delimiter(text)))
    header = records[0] if records else []
    issues: list[Issue] = []
    places: dict[str, int] = {}
    extras: list[tuple[str, int]] = []
    for i, title in enumerate(header):
        plain = title.strip().lower()
        if plain in COLUMNS and plain not in places:
            places[plain] = i
        elif plain:
            extras.append((title, i))
    for column in REQUIRED:
        if column not in places:
            issues.append(Issue("error", "missing-header", name, f'Required column "{column}" is missing from the header row.', column=column))
    rules = []
    for number, record in enumerate(records[1:], 1):
        if not any(c.strip() for c in record):
            continue
        cells = {c: record[i].strip() if i < len(record) else "" for c, i in places.items()}
        rule_id = cells.get("rule_id", "")

        def word(column: str, allowed: tuple[str, ...], default: str, label: str) -> str:
            raw = cells.get(column, "")
            if raw and raw.lower() not in allowed:
                issues.append(Issue("error", "bad-enum", name, f'{column} "{raw}" is not one of {label}.', rule_id or None, number, column))
            return raw.lower() or default

        kind = word("rule_type", TYPES, "", "validate | correct | external")
        scope = word("rule_scope", SCOPES, "", "row | column | dataset | longitudinal")
        language = word("update_language", LANGUAGES, "sql", "sql | js")
        severity = word("severity", SEVERITIES, "info" if kind == "correct" else "error", "error | warning | info")
        enabled = word("enabled", (*_TRUE, *_FALSE), "true", "true/false/yes/no/1/0 or blank")
        rules.append(Rule(
            rule_id, kind, scope, tuple(t.strip() for t in cells.get("target_variables", "").split("|") if t.strip()), cells.get("condition", ""), language,
            cells.get("update_expression", ""), severity, cells.get("comment", ""), enabled not in _FALSE, group, number,
            {title: record[i].strip() if i < len(record) else "" for title, i in extras},
        ))
    if not rules:
        issues.append(Issue("error", "empty-file", name, "File contains no rules (no data rows below the header)."))
    return RuleFile(name, group, rules, [title for title, _ in extras], issues, list(places))


def _field(text: str) -> str:
    if text[:1] in ("=", "@") or text[:1] in ("+", "-") and text[1:2] not in tuple("0123456789"):
        text = " " + text
    return '"' + text.replace('"', '""') + '"' if re.search(r'["\r\n,]', text) else text


def write_rules(file: RuleFile) -> str:
    """A rules file as text: BOM, CRLF, all defaults spelled out; reading and writing it again changes nothing."""
    rows = [[*COLUMNS, *file.extra_columns]]
    for r in file.rules:
        rows.append([r.rule_id, r.rule_type, r.rule_scope, "|".join(r.targets), r.condition, r.update_language, r.update_expression, r.severity, r.comment, "true" if r.enabled else "false", *(r.extras.get(c, "") for c in file.extra_columns)])
    return "﻿" + "".join(",".join(map(_field, row)) + "\r\n" for row in rows)


def export_name(name: str) -> str:
    return f"{group_of(name)}.rules.csv"


class RuleBook:
    """Rule files in order; the order of rules is the order of corrections."""

    def __init__(self, files: Iterable[RuleFile] = ()):
        self.files: list[RuleFile] = []
        for f in files:
            self.add(f)

    def add(self, file: RuleFile) -> None:
        """Add a file; one of the same name is replaced in its place."""
        for i, old in enumerate(self.files):
            if old.name == file.name:
                self.files[i] = file
                return
        self.files.append(file)

    def create(self, name: str) -> RuleFile:
        file = RuleFile(name, group_of(name), [])
        self.add(file)
        return file

    def file(self, name: str) -> RuleFile:
        return next(f for f in self.files if f.name == name)

    def drop(self, name: str) -> None:
        self.files = [f for f in self.files if f.name != name]

    @property
    def rules(self) -> list[Rule]:
        return [r for f in self.files for r in f.rules]

    def _place(self, rule_id: str) -> tuple[RuleFile, int]:
        for f in self.files:
            for i, r in enumerate(f.rules):
                if r.rule_id == rule_id:
                    return f, i
        raise KeyError(rule_id)

    def insert(self, name: str, rule: Rule) -> None:
        file = self.file(name)
        file.rules.append(dataclasses.replace(rule, source_file=file.group, row_number=1 + max((r.row_number for r in file.rules), default=0)))

    def update(self, rule_id: str, **changes) -> None:
        file, i = self._place(rule_id)
        file.rules[i] = dataclasses.replace(file.rules[i], **changes)

    def remove(self, rule_id: str) -> None:
        file, i = self._place(rule_id)
        del file.rules[i]

    def move(self, rule_id: str, by: int) -> None:
        file, i = self._place(rule_id)
        file.rules.insert(max(0, min(len(file.rules) - 1, i + by)), file.rules.pop(i))

    def duplicate(self, rule_id: str) -> str:
        """A copy at the end of the same file, under a new id."""
        file, i = self._place(rule_id)
        taken = {r.rule_id for r in self.rules}
        new = next(n for n in (f"{rule_id}_copy{k if k > 1 else ''}" for k in range(1, len(taken) + 3)) if n not in taken)
        self.insert(file.name, dataclasses.replace(file.rules[i], rule_id=new))
        return new
