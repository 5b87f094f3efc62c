"""Conditions between columns: which cells a schema asks about where others hold certain values, and in words.

A block ``if``/``then`` of a row is read as cases (lists of column and value) and demands
(column and schema). Demands stand in ``properties``, in parts of an ``allOf``, and, in those, in
alternatives; what only an alternative asks for is told in general words.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any

from tallyward.schema.meaning import is_scalar, value_words

#: Where demands stand: keyword of a block -> keywords that are read below it.
_BELOW = {"then": ("properties", "allOf"), "allOf": ("properties", "anyOf"), "anyOf": ("properties",)}

# Reports are compared by these words.
GENERAL = "must satisfy the conditional constraint (see schema)"
_REQUIRED_TAIL = " — a substantive or item-missing value is required"


@dataclass(frozen=True)
class Target:
    column: str
    #: const, not-const, not-enum or schema
    kind: str
    text: str


@dataclass(frozen=True)
class Conditional:
    index: int
    text: str
    pairs: tuple[tuple[str, Any], ...]
    targets: tuple[Target, ...]
    comment: str | None = None


Labels = Mapping[str, Mapping[Any, "str | None"]]


def _member(node: Any, key: str, kind: type) -> Any:
    v = node.get(key) if isinstance(node, dict) else None
    return v if isinstance(v, kind) else kind()


def _flat(v: Any) -> bool:
    return not isinstance(v, (dict, list))


def _case(test: Any) -> list[tuple[str, Any]]:
    return [(c, s["const"]) for c, s in _member(test, "properties", dict).items() if isinstance(s, dict) and "const" in s and _flat(s["const"])]


def _cases(test: dict) -> list[list[tuple[str, Any]]]:
    return list(filter(None, map(_case, test["anyOf"]))) if isinstance(test.get("anyOf"), list) else [_case(test)]


def _demands(block: Any, role: str) -> Iterator[tuple[str, Any, str]]:
    """(column, schema, what part it stands in), in order."""
    for key in _BELOW[role]:
        if key == "properties":
            yield from ((c, s, role) for c, s in _member(block, key, dict).items())
        else:
            for part in _member(block, key, list):
                yield from _demands(part, key)


def _words(column: str, v: Any, labels: Labels) -> str:
    label = labels.get(column, {}).get(v) if is_scalar(v) else None
    return value_words(v) + ("" if label is None else f" ({label})")


def _target(column: str, schema: dict, labels: Labels) -> Target:
    """The first of the forms that have words of their own."""
    no = _member(schema, "not", dict)
    forms = (
        ("const", [schema["const"]] if "const" in schema and _flat(schema["const"]) else None, "must be {}"),
        ("not-const", [no["const"]] if "const" in no and _flat(no["const"]) else None, "must not be {}" + _REQUIRED_TAIL),
        ("not-enum", list(filter(_flat, no["enum"])) if isinstance(no.get("enum"), list) else None, "must not be {}" + _REQUIRED_TAIL),
    )
    for kind, values, text in forms:
        if values is not None:
            return Target(column, kind, text.format(", ".join(_words(column, v, labels) for v in values)))
    return Target(column, "schema", GENERAL)


def conditionals(row: Any, labels: Labels) -> list[Conditional]:
    """The conditions of a row's schema; labels: of each column's codes."""
    out = []
    for index, block in enumerate(_member(row, "allOf", list)):
        if not (isinstance(block, dict) and isinstance(block.get("if"), dict) and isinstance(block.get("then"), dict)):
            continue
        targets: list[Target] = []
        for column, schema, part in _demands(block["then"], "then"):
            if part != "anyOf":
                targets += [_target(column, schema, labels)] if isinstance(schema, dict) else []
            elif Target(column, "schema", GENERAL) not in targets:
                targets.append(Target(column, "schema", GENERAL))
        cases = _cases(block["if"])
        text = " or ".join(" and ".join(f"{c} = {value_words(v)}" for c, v in case) for case in cases)
        out.append(Conditional(index, text, tuple(pair for case in cases for pair in case), tuple(targets), block["$comment"] if isinstance(block.get("$comment"), str) else None))
    return out
