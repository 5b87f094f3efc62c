"""Schemas as column expressions: every error that a row can have, with the condition under which it has it.

A row is an object of scalars, so the errors that it can have are a closed list: one for each keyword that
applies to a column or to the row, under each alternative. Conditions are plain column expressions, never null;
sentences are put together from texts and cells. Nothing here leaves the engine's own code for Python.
What has no expression (a keyword on the row as a value, columns of lists or objects) raises NotCompiled, and the
schema goes to the evaluator instead.

Each error of a cell has two forms. The wide one reads the columns of a row, and conditions between columns are
made of it. The long one reads a cell on its own (LongCells), with the constants of the schema taken from a small
table of constraints by column: columns that are checked in the same way share one expression, so a
table of hundreds of columns has a plan of a few expressions over (row, column, value).
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.sqltext import literal, quote
from tallyward.operators.checks import double_sql
from tallyward.schema import wording
from tallyward.schema.digest import Column, Digest
from tallyward.schema.loader import SchemaSet, Site
from tallyward.schema.validator import Validator, pattern, ref_path
from tallyward.schema.wording import Sentence, Slot, params_text

MAX_DEPTH = 12
SAFE_INTEGER = 9007199254740991
MIXED_NUMBER = r"-?(\d+)(\.\d+)?([eE][+-]?\d+)?"

_DAY = r"\d{4}-(?:(?:0[13578]|1[02])-(?:0[1-9]|[12]\d|3[01])|(?:0[469]|11)-(?:0[1-9]|[12]\d|30)|02-(?:0[1-9]|1\d|2[0-8]))"
_LEAP = r"(?:\d\d(?:0[48]|[2468][048]|[13579][26])|(?:[02468][048]|[13579][26])00)-02-29"
_CLOCK = r"(?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d+)?(?:[zZ]|[+-]\d\d:?\d\d)"
_LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
_BYTE = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Formats as patterns of the whole text. Others that the evaluator knows are not compiled.
FORMATS = {
    "date": f"(?:{_DAY}|{_LEAP})",
    "time": _CLOCK,
    "date-time": f"(?:{_DAY}|{_LEAP})[Tt ]{_CLOCK}",
    "duration": r"P(?!$)(?:(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:T(?=\d)(?:\d+H)?(?:\d+M)?(?:\d+S)?)?|(?:\d+W)?)",
    "email": rf"(?i)[a-z0-9!#$%&'*+/=?^_`{{|}}~-]+(?:\.[a-z0-9!#$%&'*+/=?^_`{{|}}~-]+)*@(?:{_LABEL}\.)+{_LABEL}",
    "hostname": rf"(?i)(?=.{{0,253}}\z){_LABEL}(?:\.{_LABEL})*",
    "ipv4": rf"{_BYTE}(?:\.{_BYTE}){{3}}",
    "uuid": r"(?i)(?:urn:uuid:)?[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}",
    "json-pointer": r"(?:/(?:[^~/]|~0|~1)*)*",
}
_PYTHON_ONLY = frozenset(("ipv6", "uri", "uri-reference", "regex"))


class NotCompiled(Exception):
    pass


#: SQL text. A schema of hundreds of columns has thousands of parts, which the engine parses at once.
Expression = str
YES, NO, NULL_TEXT, NULL_NUMBER = "true", "false", "CAST(NULL AS STRING)", "CAST(NULL AS DOUBLE)"


def all_of(parts: Iterable[Expression]) -> Expression:
    parts = [p for p in parts if p != YES]
    return NO if NO in parts else f"({' AND '.join(parts)})" if len(parts) > 1 else parts[0] if parts else YES


def any_of(parts: Iterable[Expression]) -> Expression:
    parts = [p for p in parts if p != NO]
    return YES if YES in parts else f"({' OR '.join(parts)})" if len(parts) > 1 else parts[0] if parts else NO


def is_not(part: Expression) -> Expression:
    return {YES: NO, NO: YES}.get(part) or f"(NOT {part})"


def sure(condition: Expression) -> Expression:
    return f"coalesce({condition}, false)"


def when(*pairs: tuple[Expression, Expression], otherwise: Expression | None = None) -> Expression:
    pairs = [x for x in pairs if x[0] != NO]
    if pairs and pairs[0][0] == YES:
        return pairs[0][1]
    if not pairs:
        return otherwise or "NULL"
    return "(CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in pairs) + (f" ELSE {otherwise}" if otherwise else "") + " END)"


def double(v: float) -> Expression:
    return f"CAST('{float(v)!r}' AS DOUBLE)"


def count_of(parts: Sequence[Expression]) -> Expression:
    """How many conditions hold."""
    return "(" + " + ".join(["0", *(f"int({p})" for p in parts)]) + ")"


def engine_pattern(text: str) -> str:
    """A pattern of the schema language in the engine's own: $ is the very end; in a class, [ and & stand for themselves."""
    space = r"\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
    out, inside, i = [], False, 0
    while i < len(text):
        c, pair = text[i], text[i : i + 2]
        if c == "\\" and len(pair) == 2:
            out.append({"\\s": space if inside else f"[{space}]", "\\S": pair if inside else f"[^{space}]", "\\/": "/"}.get(pair, pair))
            i += 2
            continue
        if c == "[" and not inside:
            inside = True
            out.append(c)
            if text[i + 1 : i + 2] == "^":
                out.append("^")
                i += 1
        elif c == "]" and inside:
            inside = False
            out.append(c)
        else:
            out.append("\\" + c if inside and c in "[&" else "\\z" if c == "$" and not inside else c)
        i += 1
    return "".join(out)


def number_words(c: Expression) -> Expression:
    """A finite double as its text in messages: whole ones without a point, exponents only below 1e-6 and from 1e21 on."""
    text = f"CAST(abs({c}) AS STRING)"
    power = f"coalesce(try_cast(regexp_extract({text}, 'E(-?[0-9]+)$', 1) AS INT), 0)"
    digits = f"regexp_replace(regexp_replace({text}, 'E.*$', ''), '[.]0$', '')"
    bare = f"replace({digits}, '.', '')"
    point = f"(length(substring_index({digits}, '.', 1)) + {power})"  # digits before the point
    plain = when(
        (f"abs({c}) >= 0.001D AND abs({c}) < 1e7D", f"regexp_replace({text}, '[.]0$', '')"),
        (f"{point} <= 0", f"concat('0.', repeat('0', -{point}), {bare})"),
        (f"{point} >= length({bare})", f"rpad({bare}, {point}, '0')"),
        otherwise=f"concat(substring({bare}, 1, {point}), '.', substring({bare}, {point} + 1))",
    )
    powered = f"concat({digits}, if({power} < 0, 'e', 'e+'), CAST({power} AS STRING))"
    size = when((f"{c} = 0", "'0'"), (f"abs({c}) >= 1e21D OR abs({c}) < 1e-6D", powered), otherwise=plain)
    return f"concat(if({c} < 0, '-', ''), {size})"


def words_of(kind: Expression, text: Expression, number: Expression) -> Expression:
    """A cell in messages."""
    return when((f"{kind} = 's'", f"concat(\"'\", {text}, \"'\")"), (f"{kind} = 'n'", number_words(number)), (f"{kind} = 'z'", "'null'"), otherwise=text)


def json_of(kind: Expression, text: Expression, number: Expression) -> Expression:
    """A cell as JSON, null for none."""
    quoted = f"to_json(named_struct('v', {text}))"
    return when((f"{kind} = 's'", f"substring({quoted}, 6, length({quoted}) - 6)"), (f"{kind} = 'n'", number_words(number)), (f"{kind} IN ('i', 'b')", text))


@dataclass(frozen=True)
class Cast:
    """How a column gets the type that a schema gives it."""

    column: str
    storage: str
    #: in SQL
    expression: Expression
    #: it cannot turn a text into null
    safe: bool
    in_schema: bool
    place: int = 0

    @property
    def alias(self) -> str:
        return f"__cast_{self.place}__"


@dataclass(frozen=True, eq=False)
class Possible:
    """An error that a row has where ``holds`` is true."""

    keyword: str
    #: of the cell that it is about, if it is about one
    column: str | None
    #: the value at fault is the cell; else the whole row
    in_cell: bool
    schema_path: str
    params: dict[str, Any]
    holds: Expression
    #: it comes with an error about alternatives of the same cell
    nested: bool = False
    #: ``holds`` as wide conditions on the row and one on the cell alone, if it is about a cell
    guards: tuple[Expression, ...] = ()
    local: Expression | None = None

    def under(self, condition: Expression, **more: Any) -> Possible:
        """The same error, only where a condition holds as well."""
        return replace(self, holds=all_of([condition, self.holds]), guards=(*self.guards, condition), **more)

    @property
    def order(self) -> tuple:
        return ("x" if self.in_cell else "", self.schema_path, self.keyword, params_text(self.params))


class WideCells:
    """Cells as columns of their rows, or as expressions that cast them; constants in the text of expressions."""

    def __init__(self, casts: Mapping[str, Expression] | None = None):
        self.casts = casts or {}

    def at(self, name: str, kind: str = "") -> Expression:
        return self.casts.get(name) or quote(name)

    def truth(self, name: str, v: bool) -> Expression:
        return f"{self.at(name)} = {str(v).lower()}"

    def whole(self, name: str) -> Expression:
        """A whole number as text."""
        return f"CAST({self.at(name)} AS STRING)"

    def text(self, name: str, v: str) -> Expression:
        return literal(v)

    def number(self, name: str, v: float) -> Expression:
        return double(v)

    def count(self, name: str, v: int) -> Expression:
        return str(int(v))

    def texts_hold(self, name: str, values: Sequence[str]) -> Expression:
        return f"{self.at(name)} IN ({', '.join(map(literal, values))})"

    def numbers_hold(self, name: str, n: Expression, values: Sequence[float]) -> Expression:
        return f"{n} IN ({', '.join(map(double, values))})"

    def like(self, name: str, form: str) -> Expression:
        return f"{self.at(name)} RLIKE {literal(form)}"


#: Columns of a cell in long form: its text or its number, its constraints and the texts about it, the conditions that its row meets, the patterns that it matches, whether it could not be cast.
TEXT, NUMBER, BY, SAY, MET, LIKE, BAD = "__text", "__number", "__by", "__say", "__met", "__like", "__bad"


class LongCells:
    """The cell at hand, and a record of each column's constants in the order in which its expression asks for them."""

    #: What conditions ask for; texts are for sentences.
    ASKED = ("numbers", "counts", "text_sets", "number_sets")
    FIELDS = {"texts": "array<string>", "numbers": "array<double>", "counts": "array<bigint>", "text_sets": "array<array<string>>", "number_sets": "array<array<double>>", "patterns": "array<int>"}

    def __init__(self) -> None:
        self.constants: dict[str, dict[str, list]] = {}
        self.forms: dict[str, int] = {}
        self.guards: dict[Expression, int] = {}

    def _slot(self, name: str, field: str, v: Any) -> Expression:
        held = self.constants.setdefault(name, {f: [] for f in self.FIELDS})[field]
        held.append(v)
        return f"{SAY if field == 'texts' else f'{BY}.{field}'}[{len(held) - 1}]"

    def at(self, name: str, kind: str) -> Expression:
        return NUMBER if kind in ("bigint", "double") else TEXT

    def truth(self, name: str, v: bool) -> Expression:
        return f"{TEXT} = '{str(v).lower()}'"

    def whole(self, name: str) -> Expression:
        return f"CAST(CAST({NUMBER} AS BIGINT) AS STRING)"

    def text(self, name: str, v: str) -> Expression:
        return self._slot(name, "texts", v)

    def number(self, name: str, v: float) -> Expression:
        return self._slot(name, "numbers", float(v))

    def count(self, name: str, v: int) -> Expression:
        return self._slot(name, "counts", int(v))

    def texts_hold(self, name: str, values: Sequence[str]) -> Expression:
        return f"array_contains({self._slot(name, 'text_sets', list(values))}, {TEXT})"

    def numbers_hold(self, name: str, n: Expression, values: Sequence[float]) -> Expression:
        return f"array_contains({self._slot(name, 'number_sets', list(map(float, values)))}, {n})"

    def like(self, name: str, form: str) -> Expression:
        self._slot(name, "patterns", self.forms.setdefault(form, len(self.forms)))
        return f"{LIKE}[{len(self.constants[name]['patterns']) - 1}]"

    def guard(self, name: str, condition: Expression) -> Expression:
        return f"{MET}[CAST({self._slot(name, 'counts', self.guards.setdefault(condition, len(self.guards)))} AS INT)]"


class Compiler:
    def __init__(self, schemas: SchemaSet, columns: dict[str, Column], present: dict[str, str], cells: WideCells | LongCells | None = None, casts: Mapping[str, Expression] | None = None):
        self.schemas, self.columns = schemas, columns
        self.present = present  # storage type of each column that is there
        self.mixed = {n for n in present if n in columns and columns[n].mixed}
        self.nullable = {n for n in present if n in columns and "null" in columns[n].types}
        self.cells = cells or WideCells(casts)
        self.local = Compiler(schemas, columns, present, LongCells()) if cells is None else None

    # Cells

    def at(self, name: str) -> Expression:
        return self.cells.at(name, self.present[name])

    def unfinite(self, name: str) -> Expression:
        c = self.at(name)
        return sure(f"(isnan({c}) OR abs({c}) = double('Infinity'))") if self.present[name] == "double" else NO

    def has(self, name: str) -> Expression:
        """Whether the row, as an object, has the property."""
        filled = YES if name in self.nullable else f"{self.at(name)} IS NOT NULL"
        return all_of([filled, is_not(self.unfinite(name))])

    def number(self, name: str) -> tuple[Expression, Expression] | None:
        """(whether the cell holds a number, that number as a double)."""
        c, kind = self.at(name), self.present[name]
        if kind in ("bigint", "double"):
            return all_of([f"{c} IS NOT NULL", is_not(self.unfinite(name))]), c if kind == "double" else f"CAST({c} AS DOUBLE)"
        if name in self.mixed:
            return sure(f"{c} RLIKE {literal(rf'\A{MIXED_NUMBER}\z')}"), f"try_cast({c} AS DOUBLE)"
        return None

    def is_text(self, name: str) -> Expression:
        if self.present[name] != "string":
            return NO
        number = self.number(name)
        return all_of([f"{self.at(name)} IS NOT NULL", is_not(number[0]) if number else YES])

    def is_type(self, name: str, kind: str) -> Expression:
        number = self.number(name)
        if kind in ("number", "integer"):
            return NO if number is None else number[0] if kind == "number" or self.present[name] == "bigint" else sure(f"({number[0]} AND rint({number[1]}) = {number[1]})")
        if kind == "null":
            return f"{self.at(name)} IS NULL"
        if kind == "boolean":
            return f"{self.at(name)} IS NOT NULL" if self.present[name] == "boolean" else NO
        return self.is_text(name) if kind == "string" else NO

    def one_of(self, name: str, values: Sequence[Any]) -> Expression:
        """Whether the cell equals one of some values."""
        parts = [f"{self.at(name)} IS NULL"] if any(v is None for v in values) else []
        if self.present[name] == "boolean":
            parts += [sure(self.cells.truth(name, v)) for v in (True, False) if any(x is v for x in values)]
        numbers = [v for v in values if isinstance(v, (int, float)) and not isinstance(v, bool)]
        if numbers and (number := self.number(name)):
            parts.append(sure(f"({number[0]} AND {self.cells.numbers_hold(name, number[1], numbers)})"))
        texts = [v for v in values if isinstance(v, str)]
        if texts and self.present[name] == "string":
            parts.append(sure(f"({self.is_text(name)} AND {self.cells.texts_hold(name, texts)})"))
        return any_of(parts)

    def held(self, name: str) -> dict[str, Expression]:
        """What a cell holds: its kind (s text, i whole number, n number, b boolean, z null), as text, and as a number."""
        c, kind, number = self.at(name), self.present[name], NULL_NUMBER
        text = f"CAST({c} AS STRING)"
        if kind == "bigint":
            kind, number, text = f"if({c} BETWEEN -{SAFE_INTEGER} AND {SAFE_INTEGER}, 'i', 'n')", f"CAST({c} AS DOUBLE)", self.cells.whole(name)
        elif kind == "double":
            kind, number, text = "'n'", c, NULL_TEXT
        elif name in self.mixed:
            is_number, number = self.number(name)
            kind = when((is_not(is_number), "'s'"), (f"{c} RLIKE '[.eE]'", "'n'"), otherwise="'i'")
            whole = f"regexp_replace({c}, '^(-?)0+(?=[0-9])', '$1')"
            text = when((is_not(is_number), c), (f"{whole} = '-0'", "'0'"), otherwise=whole)
        else:
            kind = "'b'" if kind == "boolean" else "'s'"
        return {"kind": when((f"{c} IS NULL", "'z'"), otherwise=kind) if name in self.nullable else kind, "text": text, "number": number}

    def row_json(self) -> Expression:
        """The row as a JSON object of the properties that it has."""
        parts = [when((self.has(n), f"concat({literal(wording.json.dumps(n, ensure_ascii=False) + ':')}, coalesce({json_of(**self.held(n))}, 'null'))"), otherwise=NULL_TEXT) for n in self.present]
        return f"concat('{{', concat_ws(',', {', '.join(parts)}), '}}')"

    # Errors of a cell that is there

    def cell(self, site: Site, name: str, where: str, depth: int = 0) -> list[Possible]:
        node = site.node
        if node is True or node == {}:
            return []
        if node is False:
            return [Possible("false schema", name, True, f"{where}/false schema", {}, YES)]
        if not isinstance(node, dict):
            return []
        if depth > MAX_DEPTH:
            raise NotCompiled
        out: list[Possible] = []
        sub = lambda place, at: self.cell(place, name, at, depth + 1)

        def fail(keyword: str, bad: Expression, **params: Any) -> None:
            out.append(Possible(keyword, name, True, f"{where}/{keyword}", params, bad))

        for key in ("$ref", "$dynamicRef"):
            if isinstance(node.get(key), str) and (target := self.schemas.resolve(site)) is not None:
                out += sub(target, ref_path(node[key], target, site))
        if node.get("type") is not None:
            kinds = node["type"] if isinstance(node["type"], list) else [node["type"]]
            fail("type", is_not(any_of(self.is_type(name, k) for k in kinds)), type=node["type"])
        if "const" in node:
            fail("const", is_not(self.one_of(name, [node["const"]])), allowedValue=node["const"])
        if isinstance(node.get("enum"), list):
            fail("enum", is_not(self.one_of(name, node["enum"])), allowedValues=node["enum"])
        limit = lambda key: isinstance(node.get(key), (int, float)) and not isinstance(node[key], bool)
        number = self.number(name)
        if number is not None:
            is_number, n = number
            for key, sign, bad in (("minimum", ">=", "<"), ("maximum", "<=", ">"), ("exclusiveMinimum", ">", "<="), ("exclusiveMaximum", "<", ">=")):
                if limit(key):
                    fail(key, sure(f"({is_number} AND {n} {bad} {self.cells.number(name, node[key])})"), comparison=sign, limit=node[key])
            if limit("multipleOf") and node["multipleOf"] > 0:
                q = f"({n} / {self.cells.number(name, node['multipleOf'])})"
                fail("multipleOf", sure(f"({is_number} AND abs({q} - rint({q})) > 1e-9D * greatest(1D, abs({q})))"), multipleOf=node["multipleOf"])
        if self.present[name] == "string":
            c, text = self.at(name), self.is_text(name)
            for key, bad in (("minLength", "<"), ("maxLength", ">")):
                if key in node:
                    fail(key, sure(f"({text} AND length({c}) {bad} {self.cells.count(name, node[key])})"), limit=node[key])
            unlike = lambda form: sure(f"({text} AND NOT {self.cells.like(name, form)})")
            if isinstance(node.get("pattern"), str):
                pattern(node["pattern"])  # refuses what is no pattern
                fail("pattern", unlike(engine_pattern(node["pattern"])), pattern=node["pattern"])
            if node.get("format") in _PYTHON_ONLY:
                raise NotCompiled
            if node.get("format") in FORMATS:
                form = FORMATS[node["format"]]
                fail("format", unlike(rf"{'(?i)' if form.startswith('(?i)') else ''}\A(?:{form.removeprefix('(?i)')})\z"), format=node["format"])
        for i in range(len(node.get("allOf") or [])):
            out += sub(site.child("allOf", i), f"{where}/allOf/{i}")
        self._alternatives(site, where, out, sub, fail, name)
        if "not" in node:
            fail("not", is_not(self._fails(sub(site.child("not"), f"{where}/not"))))
        self._branches(site, where, out, sub)
        return out

    @staticmethod
    def _fails(possible: Iterable[Possible]) -> Expression:
        return any_of(p.holds for p in possible)

    def _alternatives(self, site: Site, where: str, out: list[Possible], sub, fail, name: str | None = None) -> None:
        for key in ("anyOf", "oneOf"):
            if not isinstance(site.node.get(key), list):
                continue
            places = [site.child(key, i) for i in range(len(site.node[key]))]
            each = [sub(place, f"{where}/{key}/{i}") for i, place in enumerate(places)]
            codes = [self._code(place) if name else None for place in places]
            alike = [c[0] for c in codes if c]  # codes are looked up together
            none = all_of([*(self._fails(e) for e, c in zip(each, codes) if not c), is_not(self.one_of(name, alike)) if alike else YES])
            for e, c in zip(each, codes):
                out += [replace(p, holds=none, nested=p.in_cell) if c else p.under(none, nested=p.in_cell) for p in e]
            if key == "anyOf":
                fail(key, none)
                continue
            passing = count_of([is_not(self._fails(e)) for e in each])
            fail(key, none, passingSchemas=None)
            if name is None:  # its sentence would list the alternatives that passed
                raise NotCompiled
            values = [c[0] for c in codes if c]
            if len(values) < len(codes) or len({(isinstance(v, bool), v) for v in values}) < len(values):
                fail(key, f"({passing} > 1)", passingSchemas=[0, 1])

    def _code(self, site: Site, depth: int = 0) -> tuple[Any] | None:
        """The value that a schema asks for, if it asks for nothing else."""
        node = site.node
        if not isinstance(node, dict) or depth > MAX_DEPTH or set(node) - {"const", "title", "description", "$comment", "$ref"}:
            return None
        if isinstance(node.get("$ref"), str):
            target = self.schemas.resolve(site) if "const" not in node else None
            return self._code(target, depth + 1) if target is not None else None
        return (node["const"],) if "const" in node and not isinstance(node["const"], (dict, list)) else None

    def _branches(self, site: Site, where: str, out: list[Possible], sub) -> None:
        """Errors of then and else; what says that the condition failed is never told."""
        if "if" not in site.node:
            return
        met = is_not(self._fails(sub(site.child("if"), f"{where}/if")))
        for key, taken in (("then", met), ("else", is_not(met))):
            if key in site.node:
                out += [p.under(taken) for p in sub(site.child(key), f"{where}/{key}")]

    # Errors of a row

    def row(self, site: Site, where: str = "#", depth: int = 0) -> list[Possible]:
        node = site.node
        if node is True or node == {}:
            return []
        if node is False:
            return [Possible("false schema", None, False, f"{where}/false schema", {}, YES)]
        if not isinstance(node, dict):
            return []
        if depth > MAX_DEPTH or "const" in node or "enum" in node:
            raise NotCompiled
        out: list[Possible] = []
        sub = lambda place, at: self.row(place, at, depth + 1)

        def fail(keyword: str, bad: Expression, column: str | None = None, **params: Any) -> None:
            out.append(Possible(keyword, column, False, f"{where}/{keyword}", params, bad))

        def cell(place: Site, name: str, at: str) -> None:
            for p, own in zip(self.cell(place, name, at, depth + 1), self.local.cell(place, name, at, depth + 1), strict=True):
                out.append(replace(p, holds=all_of([self.has(name), p.holds]), guards=(), local=all_of([self.local.has(name), own.holds])))

        for key in ("$ref", "$dynamicRef"):
            if isinstance(node.get(key), str) and (target := self.schemas.resolve(site)) is not None:
                out += sub(target, ref_path(node[key], target, site))
        if node.get("type") is not None and "object" not in (node["type"] if isinstance(node["type"], list) else [node["type"]]):
            fail("type", YES, type=node["type"])
        for name in node.get("required") or ():
            fail("required", is_not(self.has(name)) if name in self.present else YES, name, missingProperty=name)
            if name in self.present:
                out[-1] = replace(out[-1], local=is_not(self.local.has(name)))
        filled = count_of([self.has(n) for n in self.present])
        if "minProperties" in node:
            fail("minProperties", f"({filled} < {int(node['minProperties'])})", limit=node["minProperties"])
        if "maxProperties" in node:
            fail("maxProperties", f"({filled} > {int(node['maxProperties'])})", limit=node["maxProperties"])
        escape = lambda text: str(text).replace("~", "~0").replace("/", "~1")
        known = set(node.get("properties") or ())
        for name in node.get("properties") or ():
            if name in self.present:
                cell(site.child("properties", name), name, f"{where}/properties/{escape(name)}")
        for text in node.get("patternProperties") or ():
            for name in self.present:
                if pattern(text).search(name):
                    known.add(name)
                    cell(site.child("patternProperties", text), name, f"{where}/patternProperties/{escape(text)}")
        if "additionalProperties" in node:
            for name in self.present:
                if name in known:
                    continue
                if node["additionalProperties"] is False:
                    fail("additionalProperties", self.has(name), additionalProperty=name)
                else:
                    cell(site.child("additionalProperties"), name, f"{where}/additionalProperties")
        if "propertyNames" in node and any(Validator(self.schemas, site.child("propertyNames")).errors(n) for n in self.present):
            raise NotCompiled
        for key in ("dependentRequired", "dependencies", "dependentSchemas"):
            for name, needed in (node.get(key) or {}).items():
                if name not in self.present:
                    continue
                if isinstance(needed, list) and key != "dependentSchemas":
                    for other in needed:
                        fail(key, all_of([self.has(name), is_not(self.has(other)) if other in self.present else YES]), property=name, missingProperty=other)
                elif isinstance(needed, (dict, bool)) and key != "dependentRequired":
                    out += [p.under(self.has(name)) for p in sub(site.child(key, name), f"{where}/{key}/{escape(name)}")]
        for i in range(len(node.get("allOf") or [])):
            out += sub(site.child("allOf", i), f"{where}/allOf/{i}")
        self._alternatives(site, where, out, sub, fail)
        if "not" in node:
            fail("not", is_not(self._fails(sub(site.child("not"), f"{where}/not"))))
        self._branches(site, where, out, sub)
        if "unevaluatedProperties" in node:
            always, sometimes = self._looked_at(site)
            for name in self.present:
                if name in always:
                    continue
                if name in sometimes:
                    raise NotCompiled
                if node["unevaluatedProperties"] is False:
                    out.append(Possible("unevaluatedProperties", None, False, f"{where}/unevaluatedProperties", {"unevaluatedProperty": name}, self.has(name)))
                else:
                    cell(site.child("unevaluatedProperties"), name, f"{where}/unevaluatedProperties")
        return out

    def _looked_at(self, site: Site, depth: int = 0) -> tuple[set[str], set[str]]:
        """Columns that a schema looks at whatever the row, and those that it looks at for some rows."""
        node = site.node
        if not isinstance(node, dict):
            return set(), set()
        if depth > MAX_DEPTH:
            raise NotCompiled
        always = {n for n in self.present if n in (node.get("properties") or ()) or any(pattern(t).search(n) for t in node.get("patternProperties") or ())}
        if "additionalProperties" in node or depth and "unevaluatedProperties" in node:
            always |= set(self.present)
        sometimes: set[str] = set()
        places = [site.child("allOf", i) for i in range(len(node.get("allOf") or []))]
        places += [t for t in [self.schemas.resolve(site) if isinstance(node.get("$ref"), str) else None] if t is not None]
        for place in places:
            a, b = self._looked_at(place, depth + 1)
            always, sometimes = always | a, sometimes | b
        doubtful = [site.child(k, i) for k in ("anyOf", "oneOf") for i in range(len(node.get(k) or []))]
        doubtful += [site.child(k) for k in ("if", "then", "else") if k in node] + [site.child("dependentSchemas", k) for k in node.get("dependentSchemas") or {}]
        for place in doubtful:
            a, b = self._looked_at(place, depth + 1)
            sometimes |= a | b
        return always, sometimes - always


def surely_valid(schemas: SchemaSet, site: Site, columns: dict[str, Column], present: dict[str, str]) -> F.Column | None:
    """Whether a row satisfies its schema, or None if the schema is not compiled."""
    try:
        return F.expr(is_not(any_of(p.holds for p in Compiler(schemas, columns, present).row(site))))
    except NotCompiled:
        return None


def one_each(df: DataFrame, kept: Sequence[str], array: Expression, name: str) -> DataFrame:
    """The kept columns, and the entries of an array that are not null, one each.

    The array is made by one projection and spread by the next, as a generator over hundreds of columns would be
    interpreted. The planner derives what it knows of columns for each filter and join above, which takes it minutes with
    expressions as long as these; it knows nothing of what an unpivot gives, so plans above stay short. The outer form
    keeps it from putting a filter below.
    """
    each = df.selectExpr(*kept, f"{array} AS {name}").selectExpr(*kept, f"explode_outer({name}) AS {name}")
    return apart(each).filter(f"{name} IS NOT NULL")


def _portions(branches: Sequence[Expression], size: int = 4000) -> list[Expression]:
    """Branches of a CASE, as many together as make a text of about a size."""
    out: list[list[Expression]] = [[]]
    for b in branches:
        if out[-1] and sum(map(len, out[-1])) + len(b) > size:
            out.append([])
        out[-1].append(b)
    return [" ".join(x) for x in out]


def apart(df: DataFrame) -> DataFrame:
    """The same rows. What follows is planned, and compiled into a method, of its own: methods of over 8,000 bytes are interpreted."""
    *kept, last = df.columns
    return df.unpivot([quote(k) for k in kept], [quote(last)], "__name", last).drop("__name")


class Findings:
    """Errors that rows can have as findings: one sentence for each thing that is wrong with a cell.

    The same grouping as that of the evaluator's errors, on errors that may be there. Each finding is a
    struct, null in rows that do not have it, so every condition is evaluated once. It carries the value at
    fault and the texts around it; ``told`` puts sentences together where there is a finding.

    ``wide`` holds findings about rows and about columns that are not there, ``long`` those about cells: for each column
    an array as text, which columns with the same checks have in common, and the constants that it asks for.
    """

    FIELDS = "struct<rule_id:string,scope:string,column:string,before:string,slot:string,after:string,kind:string,text:string,number:double,keyword:string,schema_path:string,conditional_index:bigint,seq:bigint>"

    def __init__(self, compiler: Compiler, found: Digest, failed: Expression | None = None, casts: Mapping[str, Cast] | None = None):
        """failed: an array of the columns of a row that could not be cast. casts: or, for columns that are still to be cast, how."""
        self.compiler, self.found, self.failed, self.casts = compiler, found, failed, casts or {}
        self.uncast = {n for n, c in self.casts.items() if not c.safe}
        self.order = {c.name: i for i, c in enumerate(found.columns)}
        self.rules = {r.index: r for r in found.conditionals}
        self.wide: list[Expression] = []
        self.long: dict[str, list[tuple[Expression, Expression]]] = {n: [] for n in compiler.present}  # (whether there is one, the finding)

    def _struct(self, comp: Compiler, of: str | None, rule_id: str, before: Expression, slot: str, after: Expression, held: dict[str, Expression] | None, column: str | None, keyword: str | None, schema_path: str | None, index: int | None = None, scope: str = "cell", first: int | None = None) -> Expression:
        """of: the column whose constants the texts are among."""
        seq = first if first is not None else 0 if column is None else 1 + self.order.get(column, len(self.order))
        text = lambda x: NULL_TEXT if x is None else comp.cells.text(of, x)
        held = held or {"kind": "''", "text": NULL_TEXT, "number": NULL_NUMBER}
        fields = {
            "rule_id": text(rule_id), "scope": literal(scope), "column": text(column), "before": before, "slot": literal(slot), "after": after, **held,
            "keyword": text(keyword), "schema_path": text(schema_path), "conditional_index": f"CAST({'NULL' if index is None else comp.cells.count(of, index)} AS BIGINT)", "seq": f"CAST({comp.cells.count(of, seq)} AS BIGINT)",
        }
        return f"named_struct({', '.join(f'{literal(k)}, {v}' for k, v in fields.items())})"

    def _said(self, comp: Compiler, of: str | None, rule_id: str, sentence: Sentence, p: Possible, column: str | None, index: int | None = None, scope: str = "cell", value: bool = True) -> Expression:
        """A finding with a sentence of at most one slot."""
        at = next((i for i, x in enumerate(sentence) if isinstance(x, Slot)), len(sentence))
        slot = "" if at == len(sentence) else sentence[at].name
        held = None if not value else comp.held(p.column) if p.in_cell else {"kind": "'r'", "text": comp.row_json(), "number": NULL_NUMBER}
        before, after = (comp.cells.text(of, "".join(part)) for part in (sentence[:at], sentence[at + 1 :]))
        return self._struct(comp, of, rule_id, before, slot, after, held, column, p.keyword, p.schema_path, index, scope)

    def told(self, each: DataFrame, row: str) -> DataFrame:
        """The findings ``x`` of rows in words."""
        words = when(("x.kind = 'r'", "x.text"), otherwise=words_of("x.kind", "x.text", "x.number"))
        kinds = "CASE WHEN x.kind = 's' THEN 'string' WHEN x.kind IN ('n', 'i') THEN 'number' WHEN x.kind = 'b' THEN 'boolean' WHEN x.kind = 'z' THEN 'null' ELSE 'object' END"
        json = when(("x.kind = 's'", json_of("'s'", "x.text", NULL_NUMBER)), ("x.kind IN ('r', 'n', 'i', 'b')", "words"), otherwise=NULL_TEXT)
        return each.select(row, "x", F.expr(words).alias("words")).selectExpr(
            "x.rule_id", "x.scope", "'error' AS severity", f"concat(x.before, CASE x.slot WHEN 'VALUE' THEN words WHEN 'KIND' THEN {kinds} ELSE '' END, x.after) AS message",
            f"CASE WHEN x.scope <> 'column' THEN {row} END AS row", "x.column", f"{json} AS value", "x.keyword", "x.schema_path", "x.conditional_index", "x.seq",
        )

    def plan(self, rows: DataFrame, row: str) -> DataFrame | None:
        """The findings ``x`` of rows, one each, or None if there can be none: cells in long form next to their constraints."""
        cells = self.compiler.local.cells
        names = [n for n, out in self.long.items() if out]
        if not names and not self.wide:
            return None
        shapes: dict[tuple[Expression, Expression], int] = {}
        likes: dict[tuple[int, ...], int] = {}
        asked, said, cast_as = [], [], {"bigint": 1, "double": 2, "boolean": 3}
        spread = []
        own = lambda n: self.casts[n].expression if n in self.casts and n not in self.uncast else quote(n)
        cell = lambda *values: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in zip(("at", "kind", "forms", "text", "number", "found"), values)) + ")"
        nothing = f"CAST(NULL AS ARRAY<{self.FIELDS}>)"
        for i, n in enumerate(names):
            shape = any_of(holds for holds, _ in self.long[n]), f"array({', '.join(x for _, x in self.long[n])})"
            held = cells.constants.get(n) or {f: [] for f in cells.FIELDS}
            number = shapes.setdefault(shape, len(shapes))
            asked.append((i, (number, *(held[f] for f in cells.ASKED))))
            said.append((i, held["texts"]))
            numeric = self.compiler.present[n] in ("bigint", "double") and n not in self.uncast
            value = (NULL_TEXT, f"CAST({own(n)} AS DOUBLE)") if numeric else (f"CAST({own(n)} AS STRING)", NULL_NUMBER)
            forms = likes.setdefault(tuple(held["patterns"]), len(likes)) if held["patterns"] else -1
            spread.append(cell(i, cast_as.get(self.casts[n].storage, 0) if n in self.uncast else 0, forms, *value, nothing))
        if self.wide:
            spread.append(cell(-1, 0, -1, NULL_TEXT, NULL_NUMBER, f"array({', '.join(self.wide)})"))
        kept = [row, *([self.failed] if self.failed else [])]
        met = f"array({', '.join(cells.guards)})" if cells.guards else "CAST(NULL AS ARRAY<BOOLEAN>)"
        # Columns are cast beforehand for conditions between columns only, all others as cells.
        told = " ".join((met, *self.wide))
        early = [f"{c.expression} AS {c.alias}" for n, c in self.casts.items() if c.alias in told]
        rows = rows.selectExpr("*", *early) if early else rows
        if not names:
            return one_each(rows, [row], f"array({', '.join(self.wide)})", "x")
        each = one_each(rows.selectExpr(*kept, f"{met} AS {MET}", f"array({', '.join(spread)}) AS cells"), [*kept, MET], "cells", "cell")
        text, number, bad = "cell.text", "cell.number", NO
        if self.failed:
            columns = f"array({', '.join(map(literal, names))})"
            bad = sure(f"array_contains({self.failed}, get({columns}, cell.at))")
        elif self.uncast:
            text = f"CASE WHEN cell.kind = 3 THEN CAST(try_cast({text} AS BOOLEAN) AS STRING) ELSE {text} END"
            each = each.selectExpr(*kept, MET, "cell", f"CASE WHEN cell.kind IN (1, 2) THEN {double_sql('cell.text')} ELSE {number} END AS read")
            # What integer_sql() gives, as a double: a whole text beyond 9.2e18 counts if it is a long.
            number = "CASE WHEN cell.kind <> 1 OR rint(read) = read AND (abs(read) < 9.2e18D OR try_cast(if(cell.text RLIKE '^\\\\s*[+-]?[0-9]+\\\\s*$', cell.text, NULL) AS BIGINT) IS NOT NULL) THEN read END"
            bad = sure(f"(cell.kind > 0 AND trim(cell.text) <> '' AND CASE WHEN cell.kind = 3 THEN {TEXT} IS NULL ELSE {NUMBER} IS NULL END)")
        forms = {i: form for form, i in cells.forms.items()}
        hits = " ".join(f"WHEN {k} THEN array({', '.join(f'{TEXT} RLIKE {literal(forms[i])}' for i in ids)})" for ids, k in likes.items())
        hits = f"CASE cell.forms {hits} END" if likes else "CAST(NULL AS ARRAY<BOOLEAN>)"
        each = each.selectExpr(*kept, MET, "cell", f"{text} AS {TEXT}", f"{number} AS {NUMBER}")
        each = apart(each.selectExpr(*kept, MET, "cell", TEXT, NUMBER, f"{bad} AS {BAD}"))
        each = each.selectExpr(*kept, MET, "cell.at AS at", "cell.found AS found", TEXT, NUMBER, BAD, f"{hits} AS {LIKE}")
        # Tables of a row for each column. Whether something is wrong is asked of all cells, sentences are for the few where it is.
        session = rows.sparkSession
        fields = ", ".join(f"{f}:{cells.FIELDS[f]}" for f in cells.ASKED)
        asks = session.createDataFrame(asked, f"ask int, {BY} struct<shape:int,{fields}>")
        says = session.createDataFrame(said, f"say int, {SAY} array<string>")
        sentences = f"CASE {BY}.shape {' '.join(f'WHEN {i} THEN {x[1]}' for x, i in shapes.items())} END"
        each = each.join(F.broadcast(asks), F.col("at") == asks.ask, "left" if self.wide else "inner")
        parts = (MET, "at", "found", TEXT, NUMBER, BAD, LIKE, BY)
        some = []
        for k, branches in enumerate(_portions([f"WHEN {i} THEN {x[0]}" for x, i in shapes.items()])):
            some.append(f"__some_{k}")
            each = apart(each.selectExpr(*kept, *parts, *some[:-1], f"coalesce(CASE {BY}.shape {branches} END, false) AS {some[-1]}"))
        if self.wide:
            some.append("found IS NOT NULL")
        wrong = f"CASE WHEN {' OR '.join(some)} THEN array(named_struct({', '.join(f'{literal(x)}, {x}' for x in parts)})) END"
        each = one_each(each, kept, wrong, "cell").select(*kept, "cell.*")
        each = each.join(F.broadcast(says), F.col("at") == says.say, "left" if self.wide else "inner")
        return one_each(each, [row], f"coalesce(found, {sentences})" if self.wide else sentences, "x")

    def build(self, possible: Sequence[Possible], prop_id, conditional_place) -> Findings:
        c = self.compiler
        own = c.local
        for i, (name, kind) in enumerate(c.present.items()):
            if kind == "double":
                at = own.at(name)
                text = when((f"isnan({at})", "'NaN'"), (f"{at} > 0", "'Infinity'"), otherwise="'-Infinity'")
                held = {"kind": "'s'", "text": text, "number": NULL_NUMBER}
                told = self._struct(own, name, prop_id(name, "cast"), text, "", "' is not a finite number.'", held, name, None, None, first=i - len(c.present))
                self.long[name].append((own.unfinite(name), when((own.unfinite(name), told))))
        cells: dict[str, list[Possible]] = {}
        loose: dict[str, list[Possible]] = {}
        for p in sorted(possible, key=lambda p: p.order):
            if p.column is not None:
                cells.setdefault(p.column, []).append(p)
            elif p.keyword == "unevaluatedProperties":
                loose.setdefault(p.params["unevaluatedProperty"], []).append(p)
            else:
                sentence = wording.keyword_sentence(p.keyword, p.params, p.schema_path, None)
                self.wide.append(when((p.holds, self._said(c, None, f"schema:row:{p.keyword}", sentence, p, None, scope="row", value=False))))
        for name, ps in loose.items():
            told = self._said(c, None, f"schema:column:{name}:unexpected", (wording.unexpected_text(name),), ps[0], name, scope="column", value=False)
            self.wide.append(when((any_of(p.holds for p in ps), told)))
        for name in sorted(cells, key=lambda n: (self.order.get(n, len(self.order)), n)):
            self._cell(name, cells[name], prop_id, conditional_place)
        self.wide = [x for x in self.wide if x not in ("NULL", "(CASE WHEN NULL THEN NULL END)")]
        self.long = {n: [x for x in out if x[0] != NO] for n, out in self.long.items()}
        return self

    def _cell(self, name: str, possible: list[Possible], prop_id, conditional_place) -> None:
        c, wide = self.found.by_name.get(name), self.compiler
        own = wide.local

        def holds(comp: Compiler, p: Possible) -> Expression:
            return p.holds if comp is wide else all_of([*(own.cells.guard(name, g) for g in p.guards if g != YES), p.local])

        def fine(comp: Compiler, but: Sequence[Possible]) -> Expression:
            """Whether the cell could be cast and has none of some errors."""
            spared = [is_not(comp.unfinite(name))] if comp.present.get(name) == "double" else []
            if self.failed is not None:
                spared.append(is_not(sure(f"array_contains({self.failed}, {literal(name)})" if comp is wide else BAD)))
            if name in self.uncast:
                spared.append(is_not(sure(f"(trim(CAST({quote(name)} AS STRING)) <> '' AND {wide.at(name)} IS NULL)") if comp is wide else BAD))
            return all_of([*spared, *(is_not(holds(comp, p)) for p in but)])

        groups: dict[int, list[Possible]] = {}
        rest: list[Possible] = []
        for p in possible:
            at = conditional_place(p.schema_path)
            (rest if at is None else groups.setdefault(at, [])).append(p)

        def first_of(ps: Sequence[Possible], told, but: Sequence[Possible] = (), value: bool = True) -> None:
            """The first of these errors that the row has; on the cell alone if the row is not told."""
            alone = name in wide.present and all(p.local is not None and (p.in_cell or not value) for p in (*ps, *but))
            comp = own if alone else wide
            each, spared = [(holds(comp, p), told(comp, p)) for p in ps], fine(comp, but)
            first = when((spared, when(*each)))
            if alone:
                self.long[name].append((all_of([any_of(h for h, _ in each), spared]), first))
            else:
                self.wide.append(first)

        def by_keyword(comp: Compiler, p: Possible) -> Expression:
            if p.keyword == "oneOf" and p.params["passingSchemas"]:
                raise NotCompiled
            return self._said(comp, name, prop_id(name, "value"), (*wording.keyword_sentence(p.keyword, p.params, p.schema_path, c), wording.trailer(c)), p, name)

        for index in sorted(groups):
            rule = self.rules.get(index)
            if rule is None:
                for p in groups[index]:
                    first_of([p], by_keyword)
                continue
            target = next((t for t in rule.targets if t.column == name), None)
            begin = f"when {rule.text}, {name} {target.text if target else 'must satisfy the conditional constraint (see schema)'}."
            end = f" [Schema note: {rule.comment}]" if rule.comment else ""
            sentence = (begin + end,) if target and target.kind == "not-const" else (begin + " Found ", Slot.VALUE, "." + end)
            first_of(groups[index], lambda comp, p, s=sentence, i=index: self._said(comp, name, f"schema:cond:{i}:{name}", s, p, name, i))
        required = [p for p in rest if p.keyword == "required" and not p.in_cell]
        unions = [p for p in rest if p.keyword in ("anyOf", "oneOf") and p.in_cell]
        # A cell that is missing has no other fault, and one that fits no alternative is told of once.
        if required and (name in wide.present or c is None):
            first_of(required, lambda comp, p: self._said(comp, name, prop_id(name, "required"), (wording.REQUIRED_MESSAGE,), p, name, value=False), value=False)

        def alternatives(comp: Compiler, p: Possible) -> Expression:
            number = comp.number(name)
            tests = {"any": YES} | ({} if number is None else {"below": "<", "above": ">"})
            begins = [(YES if test == "any" else sure(f"({number[0]} AND {number[1]} {tests[test]} {comp.cells.number(name, bound)})"), comp.cells.text(name, words)) for test, bound, (_, words) in wording.complaints(c) if test in tests]
            begin = when(*begins[:-1], otherwise=begins[-1][1])
            end = comp.cells.text(name, wording.alternatives_end(c, bool(p.params.get("passingSchemas"))))
            return self._struct(comp, name, prop_id(name, "value"), "''", Slot.VALUE.name, f"concat({begin}, {end})", comp.held(name), name, p.keyword, p.schema_path)

        if unions:
            first_of(unions, alternatives, required)
        for p in rest:
            if p not in required and p not in unions and not p.nested:
                first_of([p], by_keyword, [*required, *unions])
