"""Sentences about cells and rows that break a schema.

A sentence is a tuple of texts and slots; the engine fills the slots with column
expressions, the evaluator with values, so both say the same. The sentences
themselves are fixed values: reports are compared by them.
"""

from __future__ import annotations

import enum
import json
import re
from collections.abc import Callable
from typing import Any

from tallyward.schema.digest import Column
from tallyward.schema.meaning import bound_text, code_words, expectation, value_words


class Slot(enum.Enum):
    #: the value at fault, and what kind of value it is
    VALUE = 1
    KIND = 2


Sentence = tuple["str | Slot", ...]

# Sentences that say the same of any value.
REQUIRED_MESSAGE = "value is missing — this variable is required for every record."
PRECISION_MESSAGE = "value exceeds the exactly-representable integer range (±(2^53−1)) — schema checks used the nearest representable number."
SEVERAL = " (matches more than one exclusive option)"


def unexpected_text(column: str) -> str:
    return f"Column '{column}' is not defined in the schema, which does not allow unexpected variables."


def shown(v: Any) -> str:
    """A value in messages; objects and lists as JSON, with numbers as everywhere in messages."""
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_inner(x)}" for k, x in v.items()) + "}"
    return "[" + ",".join(map(_inner, v)) + "]" if isinstance(v, list) else value_words(v)


def _inner(v: Any) -> str:
    return json.dumps(v, ensure_ascii=False) if isinstance(v, str) else shown(v)


def kind_word(v: Any) -> str:
    for word, kinds in (("boolean", bool), ("number", (int, float)), ("string", str), ("null", type(None))):
        if isinstance(v, kinds):
            return word
    return "object"


def fill(sentence: Sentence, v: Any) -> str:
    return "".join(p if isinstance(p, str) else shown(v) if p is Slot.VALUE else kind_word(v) for p in sentence)


def params_text(params: dict[str, Any]) -> str:
    return json.dumps(params, separators=(",", ":"), ensure_ascii=False)


def trailer(c: Column | None) -> str:
    notes = c.notes if c else {}
    return "".join(f" [{label}: {notes[key]}]" for label, key in (("Unit", "unit"), ("Universe", "universe"), ("Note", "$comment")) if key in notes)


_COUNTS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split()


def pattern_words(text: str) -> str | None:
    """A pattern of letters and counted digits in words, or None for any other."""
    body, parts = text.removeprefix("^").removesuffix("$"), []
    for m in re.finditer(r"([A-Za-z_]+)|(?:\[0-9\]|\\d)\{(\d+)\}|(.)", body, re.DOTALL):
        if m[3] is not None or m[2] and int(m[2]) >= len(_COUNTS):
            return None
        parts.append(f"'{m[1]}'" if m[1] else f"{_COUNTS[int(m[2])]} digit{'' if int(m[2]) == 1 else 's'}")
    return " followed by ".join(parts) or None


def wanted(c: Column | None) -> str:
    """What a cell should hold."""
    if c is None:
        return "a value satisfying the schema"
    spec = c.spec
    words = pattern_words(spec.pattern) if spec.kind == "string-pattern" and spec.title is not None else None
    if words is None:
        return expectation(spec)
    codes = "; ".join(map(code_words, spec.sentinels))
    return f"{'an' if spec.title[:1].lower() in 'aeiou' else 'a'} {spec.title} ({words})" + (f", or one of: {codes}" if codes else "")


def complaints(c: Column | None) -> list[tuple[str, float | None, Sentence]]:
    """How a sentence on alternatives begins: (test, bound, beginning); the first whose test holds counts.

    Tests: ``below`` and ``above`` hold for numbers beyond a bound, ``any`` always.
    """
    spec = c.spec if c else None
    out: list[tuple[str, float | None, Sentence]] = []
    if spec and spec.kind == "numeric":
        bounds = (("below", spec.low, "is below the minimum"), ("above", spec.high, "exceeds the maximum"))
        out = [(test, bound, (Slot.VALUE, f" {words} {bound_text(bound)}")) for test, bound, words in bounds if bound is not None]
    last = "an allowed value" if spec and spec.kind == "codes" else "valid"
    return [*out, ("any", None, (Slot.VALUE, f" is not {last}"))]


def applies(test: str, bound: float | None, v: Any) -> bool:
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    return test == "any" or number and (v < bound if test == "below" else v > bound)


def alternatives_end(c: Column | None, several: bool) -> str:
    return f" — expected {wanted(c)}{SEVERAL if several else ''}.{trailer(c)}"


def _pattern(params: dict[str, Any], c: Column | None) -> Sentence:
    spec = c.spec if c else None
    gloss = f" — {spec.description.removesuffix('.')}" if spec and spec.kind == "string-pattern" and spec.description else ""
    return Slot.VALUE, f" does not match the expected format (pattern {params['pattern']}{gloss})."


def _enum(params: dict[str, Any], c: Column | None) -> Sentence:
    return Slot.VALUE, f" is not an allowed value — expected one of {', '.join(map(shown, params['allowedValues']))}."


def _type(params: dict[str, Any], c: Column | None) -> Sentence:
    kinds = params["type"] if isinstance(params["type"], list) else [params["type"]]
    text = " or ".join(kinds)
    return f"must be {'an' if text[0] in 'aeiou' else 'a'} {text}, got ", Slot.KIND, "."


def _const(params: dict[str, Any], c: Column | None) -> Sentence:
    allowed, spec = params["allowedValue"], c.spec if c else None
    pools = (*spec.codes, *spec.sentinels) if spec and spec.kind not in ("mixed", "opaque") else ()
    label = next((x.label for x in pools if x.value == allowed and x.label is not None), None)
    return (f"must be {shown(allowed)}" + (f" ({label})" if label else "") + ".",)


_BY_KEYWORD: dict[str, Callable[[dict[str, Any], Column | None], Sentence]] = {
    "pattern": _pattern,
    "enum": _enum,
    "type": _type,
    "const": _const,
    "minimum": lambda params, c: (Slot.VALUE, f" is below the minimum {bound_text(params['limit'])}."),
    "maximum": lambda params, c: (Slot.VALUE, f" exceeds the maximum {bound_text(params['limit'])}."),
}


def keyword_sentence(keyword: str, params: dict[str, Any], schema_path: str, c: Column | None) -> Sentence:
    if keyword in _BY_KEYWORD:
        return _BY_KEYWORD[keyword](params, c)
    said = params_text(params)
    return (f"value fails the '{keyword}' constraint {said + ' ' if said != '{}' else ''}(schema: {schema_path})",)
