"""How well a dataset, a schema and rules fit each other, by column names."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field


def folded(name: str) -> str:
    return unicodedata.normalize("NFC", name).strip().lower()


@dataclass(frozen=True)
class Pertinence:
    score: float
    #: ok, warn or block
    verdict: str
    missing_required: list[str]
    missing_optional: list[str]
    extra: list[str]
    #: (name in the dataset, name asked for)
    case_mismatches: list[tuple[str, str]]


def pertinence(wanted: Sequence[tuple[str, bool]], columns: Sequence[str]) -> Pertinence | None:
    """Names asked for, with whether they are required, against the columns there are; None if nothing is asked for."""
    if not wanted:
        return None
    have, names = set(columns), {n for n, _ in wanted}
    extra = [c for c in columns if c not in names]
    near = {folded(c): c for c in reversed(extra)}
    missing = [n for n, _ in wanted if n not in have]
    pairs = [(near[folded(n)], n) for n in missing if folded(n) in near]
    required = dict(wanted)
    score = (len(names) - len(missing)) / len(names)
    verdict = "block" if score < 0.5 else "warn" if score < 1 else "ok"
    return Pertinence(score, verdict, [n for n in missing if required[n]], [n for n in missing if not required[n]], extra, pairs)


@dataclass(frozen=True)
class CrossCheck:
    schema_to_data: Pertinence | None
    rules_to_data: Pertinence | None
    rules_to_schema: Pertinence | None
    #: the part that agrees with neither of the others, if there is one
    suspect: str | None
    notes: list[str] = field(default_factory=list)


def cross_check(columns: Sequence[str], schema_columns: Sequence[tuple[str, bool]] | None = None, rule_targets: Iterable[str] | None = None) -> CrossCheck:
    """The three ways of fitting; where two of them are bad, the part they share is the suspect."""
    targets = None if rule_targets is None else [(t, True) for t in dict.fromkeys(rule_targets)]
    a = pertinence(schema_columns, columns) if schema_columns is not None else None
    b = pertinence(targets, columns) if targets is not None else None
    c = pertinence(targets, [n for n, _ in schema_columns]) if targets is not None and schema_columns is not None else None
    bad = {k for k, p in (("sd", a), ("rd", b), ("rs", c)) if p is not None and p.verdict == "block"}
    suspect = None
    if a is not None and b is not None and c is not None:
        suspect = {frozenset(("sd", "rd")): "dataset", frozenset(("sd", "rs")): "schema", frozenset(("rd", "rs")): "rules"}.get(frozenset(bad))
    elif bad == {"sd"}:
        suspect = "schema or dataset"
    elif bad == {"rd"}:
        suspect = "rules or dataset"
    notes = []
    for label, p in (("schema and dataset", a), ("rules and dataset", b), ("rules and schema", c)):
        if p is not None and p.verdict != "ok":
            notes.append(f"{label}: {round(100 * p.score)}% of names match")
    return CrossCheck(a, b, c, suspect, notes)
