"""What a schema lets a cell be, as a list of offers, and in words.

Every schema of a value is brought into one form: offers, each a literal or a range of values of
one kind. A keyword is a function from its value to offers; the table of them is ordered by which
keyword decides if there are several. Specifications and sentences are read off the offers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import Any

from tallyward.plans.flags import number_text
from tallyward.schema.loader import SchemaSet, Site

MAX_DEPTH = 12
#: Codes that are told before the rest is only counted.
SHOWN_CODES = 8


@dataclass(frozen=True)
class Code:
    value: str | float
    label: str | None = None


@dataclass(frozen=True)
class ValueSpec:
    #: numeric, codes, string-pattern, string-free, boolean, mixed or opaque
    kind: str
    number: str = "integer"
    low: float | None = None
    high: float | None = None
    exclusions: tuple[Code, ...] = ()
    codes: tuple[Code, ...] = ()
    sentinels: tuple[Code, ...] = ()
    pattern: str = ""
    title: str | None = None
    description: str | None = None
    rendered: str | None = None


@dataclass(frozen=True)
class Offer:
    """One way for a value to be allowed."""

    #: literal, numeric, string-pattern, string-free, boolean or opaque; all but literals are kinds of specifications
    kind: str
    value: Any = None
    title: str | None = None
    description: str | None = None
    whole: bool = True
    low: float | None = None
    high: float | None = None
    barred: tuple[Any, ...] = ()
    #: the literal stands in a definition that the schema refers to, as codes for missing values do
    shared: bool = False


@dataclass(frozen=True)
class _Place:
    """A schema that offers are asked of."""

    site: Site
    schemas: SchemaSet
    shared: bool = False
    depth: int = 0

    def at(self, site: Site, shared: bool = False) -> Iterator[Offer]:
        return offers(_Place(site, self.schemas, shared, self.depth + 1))

    def each(self, key: str) -> Iterator[Offer]:
        for i in range(len(self.site.node[key])):
            yield from self.at(self.site.child(key, i))

    def said(self, key: str) -> str | None:
        v = self.site.node.get(key)
        return v if isinstance(v, str) else None


_OPAQUE = Offer("opaque")


def is_scalar(v: Any) -> bool:
    return isinstance(v, (str, int, float)) and not isinstance(v, bool)


def _literal(v: Any, place: _Place, title: str | None = None) -> Offer:
    return Offer("literal", v, title, shared=place.shared) if is_scalar(v) else _OPAQUE


def _referred(place: _Place) -> list[Offer]:
    target = place.schemas.resolve(place.site)
    found = [_OPAQUE] if target is None else list(place.at(target, True))
    title = place.said("title")  # a title next to a reference names the one thing referred to
    return [replace(o, title=title) if title is not None and len(found) == 1 and o.kind in ("literal", "string-pattern") else o for o in found]


def _barred(node: dict) -> tuple[Any, ...]:
    no = node.get("not")
    no = no if isinstance(no, dict) else {}
    return tuple(filter(is_scalar, no["enum"] if isinstance(no.get("enum"), list) else [no["const"]] if "const" in no else ()))


def _of_type(place: _Place) -> list[Offer]:
    node, kind = place.site.node, place.site.node["type"]
    if kind in ("integer", "number"):
        low, high = (node[k] if isinstance(node.get(k), (int, float)) else None for k in ("minimum", "maximum"))
        return [Offer("numeric", whole=kind == "integer", low=low, high=high, barred=_barred(node))]
    if kind == "string" and place.said("pattern") is not None:
        return [Offer("string-pattern", node["pattern"], place.said("title"), place.said("description"))]
    return [{"string": Offer("string-free"), "boolean": Offer("boolean")}.get(kind, _OPAQUE) if isinstance(kind, str) else _OPAQUE]


_List = Callable[[Any], bool]
_a_list: _List = lambda v: isinstance(v, list)
#: keyword -> (values of it that count, what it offers), the deciding one first
_KEYWORDS: dict[str, tuple[_List, Callable[[_Place], Any]]] = {
    "$ref": (lambda v: isinstance(v, str), _referred),
    "anyOf": (_a_list, lambda p: p.each("anyOf")),
    "oneOf": (_a_list, lambda p: p.each("oneOf")),
    "allOf": (lambda v: isinstance(v, list) and len(v) == 1, lambda p: p.at(p.site.child("allOf", 0), p.shared)),
    "const": (lambda v: True, lambda p: [_literal(p.site.node["const"], p, p.said("title"))]),
    "enum": (_a_list, lambda p: [_literal(v, p) for v in p.site.node["enum"]]),
    "type": (lambda v: True, _of_type),
}


def offers(place: _Place) -> Iterator[Offer]:
    node = place.site.node
    if isinstance(node, dict) and place.depth <= MAX_DEPTH:
        for key, (counts, give) in _KEYWORDS.items():
            if key in node and counts(node[key]):
                yield from give(place)
                return
    yield _OPAQUE


def value_spec(site: Site, schemas: SchemaSet) -> ValueSpec:
    found = list(offers(_Place(site, schemas)))
    literals = [o for o in found if o.kind == "literal"]
    ranges = [o for o in found if o.kind != "literal"]
    kinds = {o.kind for o in ranges}
    if not found or "opaque" in kinds:
        return ValueSpec("opaque", rendered=f"a value satisfying the schema at {site.file.path}#{site.pointer}")
    if len(kinds) > 1:
        return ValueSpec("mixed")
    as_codes = lambda some: tuple(Code(o.value, o.title) for o in some)
    if not kinds:
        return ValueSpec("codes", codes=as_codes(o for o in literals if not o.shared), sentinels=as_codes(o for o in literals if o.shared))
    spec, first = ValueSpec(kinds.pop(), sentinels=as_codes(literals)), ranges[0]
    if spec.kind == "numeric":
        label = {o.value: o.title for o in literals}
        barred = tuple(Code(v, label.get(v)) for o in ranges for v in o.barred)
        return replace(spec, number="integer" if all(o.whole for o in ranges) else "number", low=first.low, high=first.high, exclusions=barred)
    return replace(spec, pattern=first.value or "", title=first.title, description=first.description)


# Words. The sentences are fixed values: reports are compared by them.

_NOUNS = {("numeric", "integer"): "an integer", ("numeric", "number"): "a number", ("string-free", "integer"): "text", ("boolean", "integer"): "a boolean"}
_BOUNDS = {(True, True): " {low}–{high}", (True, False): " at least {low}", (False, True): " at most {high}", (False, False): ""}
_BARRED = " (sentinel codes are not valid substantive values)"
_MISSING = ", or a missing-value code ({})"
_ONE_OF = "one of: {}"
_MORE = "; … ({} more — see column tooltip)"
_OTHER = {"mixed": "a value of one of several types (see schema)"}
_ANY = "a value satisfying the schema"


def bound_text(v: float) -> str:
    """A number with thousands separators and at most three decimals."""
    if isinstance(v, float) and not v.is_integer():
        return f"{v:,.3f}".rstrip("0").rstrip(".")
    return f"{int(v):,}"


def value_words(v: Any) -> str:
    if isinstance(v, str):
        return f"'{v}'"
    if v is None:
        return "null"
    return ("true" if v else "false") if isinstance(v, bool) else number_text(v)


def code_words(c: Code) -> str:
    return value_words(c.value) + ("" if c.label is None else f" {c.label}")


def _codes(codes: tuple[Code, ...]) -> str:
    more = len(codes) - SHOWN_CODES
    return "; ".join(map(code_words, codes[:SHOWN_CODES])) + (_MORE.format(more) if more > 0 else "")


def expectation(spec: ValueSpec) -> str:
    """What a column takes, in words."""
    if spec.kind == "codes":
        return _ONE_OF.format(_codes(spec.codes + spec.sentinels))
    if spec.kind == "string-pattern":
        gloss = next((f" ({x})" for x in (spec.title, spec.description) if x is not None), "")
        return f"text matching {spec.pattern}{gloss}" + (f", or {_ONE_OF.format(_codes(spec.sentinels))}" if spec.sentinels else "")
    noun = _NOUNS.get((spec.kind, spec.number))
    if noun is None:
        return spec.rendered or _OTHER.get(spec.kind, _ANY)
    bounds = {k: bound_text(v) for k, v in (("low", spec.low), ("high", spec.high)) if v is not None}
    inside = any(not isinstance(c.value, str) and (spec.low is None or spec.low <= c.value) and (spec.high is None or c.value <= spec.high) for c in spec.exclusions)
    ending = _MISSING.format(", ".join(map(code_words, spec.sentinels))) if spec.sentinels else ""
    return noun + _BOUNDS["low" in bounds, "high" in bounds].format(**bounds) + (_BARRED if inside else "") + ending
