"""Rule text is SQL in the dialect its authors know; this module reads it and puts it into Spark's.

Only code is ever changed: strings, quoted names and comments keep their content.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

_DOLLAR = re.compile(r"\$([A-Za-z_][A-Za-z0-9_]*)?\$")
_WORD = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_NUMBER = re.compile(r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")
_OPERATOR = re.compile(r"::|\|\||//|<>|!=|<=|>=|==|->>|->|=>|\*\*")
VALUE_TOKEN = "__value__"


class SqlTextError(ValueError):
    """Rule text that cannot be run."""


@dataclass(frozen=True)
class Token:
    #: word, number, op, space, string, name, comment
    kind: str
    text: str

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else ""


def tokenize(sql: str) -> list[Token]:
    """All of a text, in order; joining the texts of the tokens gives it back."""
    out: list[Token] = []
    at, end = 0, len(sql)

    def quoted(quote: str) -> int:
        i = at + 1
        while i < end:
            if sql[i] == quote:
                if sql[i + 1 : i + 2] != quote:
                    return i + 1
                i += 1
            i += 1
        return end

    while at < end:
        c, stop = sql[at], at + 1
        if c == "'":
            kind, stop = "string", quoted("'")
        elif c == '"':
            kind, stop = "name", quoted('"')
        elif sql.startswith("--", at):
            kind, stop = "comment", sql.find("\n", at)
            stop = end if stop < 0 else stop
        elif sql.startswith("/*", at):
            kind, depth, stop = "comment", 1, at + 2
            while depth and stop < end:
                if sql.startswith("/*", stop):
                    depth, stop = depth + 1, stop + 2
                elif sql.startswith("*/", stop):
                    depth, stop = depth - 1, stop + 2
                else:
                    stop += 1
        elif c == "$" and (m := _DOLLAR.match(sql, at)):
            close = sql.find(m[0], m.end())
            kind, stop = "string", end if close < 0 else close + len(m[0])
        elif c.isspace():
            kind = "space"
            while stop < end and sql[stop].isspace():
                stop += 1
        elif m := _WORD.match(sql, at):
            kind, stop = "word", m.end()
        elif m := _NUMBER.match(sql, at):
            kind, stop = "number", m.end()
        elif m := _OPERATOR.match(sql, at):
            kind, stop = "op", m.end()
        else:
            kind = "op"
        out.append(Token(kind, sql[at:stop]))
        at = stop
    return out


def join(tokens: list[Token]) -> str:
    return "".join(t.text for t in tokens)


def semicolons(sql: str) -> tuple[int, bool]:
    """(number of top-level semicolons, whether the last has nothing but space and comments behind it)."""
    tokens = tokenize(sql)
    at = [i for i, t in enumerate(tokens) if t.kind == "op" and t.text == ";"]
    return len(at), bool(at) and all(t.kind in ("space", "comment") for t in tokens[at[-1] + 1 :])


def strip_semicolon(sql: str) -> str:
    """The text without a trailing semicolon; a comment that ends the text is closed by a line end."""
    count, trailing = semicolons(sql)
    tokens = tokenize(sql)
    if trailing:
        last = max(i for i, t in enumerate(tokens) if t.kind == "op" and t.text == ";")
        tokens = tokens[:last] + tokens[last + 1 :]
    text = join(tokens)
    if tokens and any(t.kind == "comment" and t.text.startswith("--") for t in tokens[-1:]):
        text += "\n"
    return text


def has_value_token(sql: str) -> bool:
    return any(t.kind == "word" and t.text.lower() == VALUE_TOKEN for t in tokenize(sql))


def put_value(sql: str, column: str) -> str:
    """The text with every value token replaced by a quoted column name."""
    name = quote_source(column)
    return "".join(name if t.kind == "word" and t.text.lower() == VALUE_TOKEN else t.text for t in tokenize(sql))


def check_name(name: str) -> str:
    if not name or "\0" in name:
        raise SqlTextError("a column name must not be empty or hold a NUL")
    return name


def quote_source(name: str) -> str:
    """A name quoted as rule authors do."""
    return '"' + check_name(name).replace('"', '""') + '"'


def quote(name: str) -> str:
    """A name quoted for Spark."""
    return "`" + check_name(name).replace("`", "``") + "`"


def literal(value: str) -> str:
    """A string literal for Spark."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Functions of the source dialect with a twin of another name.
_RENAMED = {
    "quantile_cont": "percentile", "quantile": "percentile", "regexp_matches": "regexp_like", "strlen": "octet_length",
    "starts_with": "startswith", "prefix": "startswith", "ends_with": "endswith", "suffix": "endswith",
    "json_extract_string": "get_json_object", "list_value": "array", "list_contains": "array_contains",
    "epoch": "unix_timestamp", "random": "rand", "ifnull": "nvl", "bool_and": "every", "bool_or": "some",
}
_TYPES = {"VARCHAR": "STRING", "TEXT": "STRING", "BPCHAR": "STRING", "HUGEINT": "DECIMAL(38,0)", "REAL": "FLOAT", "INT8": "BIGINT", "INT4": "INT", "INT2": "SMALLINT", "UBIGINT": "DECIMAL(20,0)", "UINTEGER": "BIGINT"}
_UNSUPPORTED = {"QUALIFY": "QUALIFY", "ASOF": "ASOF JOIN", "POSITIONAL": "POSITIONAL JOIN"}
#: Functions that reach beyond the data.
_FORBIDDEN = frozenset("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length read_files session_user current_user current_catalog raise_error ai_query".split())
NUMERIC = r"^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$"
_DATE = r"^\\s*\\d+-\\d{1,2}-\\d{1,2}"


def _solid(tokens: list[Token], at: int, step: int = 1) -> int:
    """Place of the next token from ``at`` on that is not space or comment, or -1."""
    while 0 <= at < len(tokens):
        if tokens[at].kind not in ("space", "comment"):
            return at
        at += step
    return -1


def _closing(tokens: list[Token], at: int) -> int:
    """Place of the bracket that closes the one at ``at``."""
    depth = 0
    for i in range(at, len(tokens)):
        if tokens[i].kind == "op":
            depth += tokens[i].text in "([" and tokens[i].text != ""
            depth -= tokens[i].text in ")]"
            if depth == 0:
                return i
    raise SqlTextError("a bracket is never closed")


def _split(tokens: list[Token], on: str = ",") -> list[list[Token]]:
    parts: list[list[Token]] = [[]]
    depth = 0
    for t in tokens:
        if t.kind == "op":
            depth += t.text in ("(", "[")
            depth -= t.text in (")", "]")
        if depth == 0 and (t.text if t.kind == "op" else t.upper) == on:
            parts.append([])
        else:
            parts[-1].append(t)
    return parts


def _type(tokens: list[Token]) -> list[Token]:
    i = _solid(tokens, 0)
    if i >= 0 and tokens[i].upper in _TYPES:
        rest = tokens[i + 1 :]
        if (j := _solid(rest, 0)) >= 0 and rest[j].text == "(" and _TYPES[tokens[i].upper] == "STRING":
            rest = rest[_closing(rest, j) + 1 :]
        return [*tokens[:i], Token("op", _TYPES[tokens[i].upper]), *rest]
    return tokens


def _cast(name: str, inside: list[Token]) -> str:
    depth = 0
    for i in range(len(inside) - 1, -1, -1):
        t = inside[i]
        if t.kind == "op":
            depth += t.text in ")]"
            depth -= t.text in "(["
        if depth == 0 and t.upper == "AS":
            break
    else:
        return f"{name}({_rewrite(inside)})"
    value, kind = _rewrite(inside[:i]).strip(), join(_type(inside[i + 1 :])).strip()
    if name.upper() == "TRY_CAST":
        text = f"CAST({value} AS STRING)"
        if kind.upper() in ("DOUBLE", "FLOAT"):
            return f"CASE WHEN {text} RLIKE '{NUMERIC}' THEN TRY_CAST({value} AS {kind}) WHEN lower(trim({text})) IN ('inf', '-inf', 'nan', 'infinity', '-infinity') THEN TRY_CAST({value} AS {kind}) END"
        if kind.upper() in ("BIGINT", "INT", "INTEGER", "SMALLINT", "TINYINT"):
            return f"coalesce(TRY_CAST({value} AS {kind}), CASE WHEN {text} RLIKE '{NUMERIC}' THEN TRY_CAST(round(TRY_CAST({value} AS DOUBLE)) AS {kind}) END)"
        if kind.upper() == "DATE":
            return f"CASE WHEN {text} RLIKE '{_DATE}' THEN TRY_CAST({value} AS DATE) END"
    return f"{name}({value} AS {kind})"


def _call(name: str, inside: list[Token], after: list[Token]) -> tuple[str, int]:
    """A function call in Spark's dialect, and how many tokens behind its bracket it takes along."""
    lower = name.lower()
    if lower in _FORBIDDEN:
        raise SqlTextError(f"{lower} is not available in rules")
    if lower in ("cast", "try_cast"):
        return _cast(name, inside), 0
    arguments = [_rewrite(a).strip() for a in _split(inside)]
    if lower == "regexp_full_match" and len(arguments) >= 2:
        flags = "(?i)" if len(arguments) > 2 and "i" in arguments[2] else ""
        return f"(({arguments[0]}) RLIKE concat('{flags}\\\\A(?:', {arguments[1]}, ')\\\\z'))", 0
    if lower == "isfinite" and len(arguments) == 1:
        return f"(NOT isnan({arguments[0]}) AND abs({arguments[0]}) < double('Infinity'))", 0
    if lower == "trunc" and len(arguments) == 1:
        return f"(CASE WHEN {arguments[0]} < 0 THEN ceil({arguments[0]}) ELSE floor({arguments[0]}) END)", 0
    if lower == "date_diff" and len(arguments) == 3:
        return f"timestampdiff({arguments[0].strip(chr(39))}, {arguments[1]}, {arguments[2]})", 0
    if lower == "random":
        return "rand(42)", 0
    if lower in ("string_agg", "listagg", "group_concat"):
        parts = _split(inside, "ORDER")
        if len(parts) == 2:
            first = _rewrite(parts[0]).strip()
            return f"listagg({first}) WITHIN GROUP (ORDER {_rewrite(parts[1]).strip()})", 0
    if lower == "count":
        i = _solid(inside, 0)
        j = _solid(after, 0)
        if i >= 0 and inside[i].upper == "DISTINCT" and j >= 0 and after[j].upper == "OVER":
            k = _solid(after, j + 1)
            stop = _closing(after, k)
            return f"size(collect_set({_rewrite(inside[i + 1 :]).strip()}) OVER {_rewrite(after[k : stop + 1])})", stop + 1
    return f"{_RENAMED.get(lower, name)}({_rewrite(inside)})", 0


def _rewrite(tokens: list[Token]) -> str:
    out: list[str] = []
    i = 0
    while i < len(tokens):
        t = tokens[i]
        if t.kind == "string":
            m = _DOLLAR.match(t.text)
            content = t.text[len(m[0]) : -len(m[0])] if m else t.text[1:-1].replace("''", "'")
            out.append(literal(content))
        elif t.kind == "name":
            out.append(quote(t.text[1:-1].replace('""', '"')))
        elif t.kind == "comment":
            out.append(" ")
        elif t.kind == "op" and t.text == "//":
            out.append(" DIV ")
        elif t.kind == "op" and t.text == "::":
            j = _solid(tokens, i + 1)
            if j >= 0 and tokens[j].upper in _TYPES:
                out.append("::" + _TYPES[tokens[j].upper])
                i = j
            else:
                out.append("::")
        elif t.kind == "word":
            j = _solid(tokens, i + 1)
            if t.upper in _UNSUPPORTED and (t.upper == "QUALIFY" or j >= 0 and tokens[j].upper == "JOIN"):
                raise SqlTextError(f"{_UNSUPPORTED[t.upper]} is not supported")
            if t.upper == "EXCLUDE" and _solid(tokens, i - 1, -1) >= 0 and tokens[_solid(tokens, i - 1, -1)].text == "*":
                out.append("EXCEPT")
            elif t.upper == "REPLACE" and _solid(tokens, i - 1, -1) >= 0 and tokens[_solid(tokens, i - 1, -1)].text == "*":
                raise SqlTextError("* REPLACE is not supported")
            elif j >= 0 and tokens[j].text == "(" and tokens[j].kind == "op" and t.upper not in ("IN", "AND", "OR", "NOT", "OVER", "BETWEEN", "WHEN", "THEN", "ELSE", "AS", "FROM", "SELECT", "WHERE", "ON", "BY", "EXCEPT", "UNION", "VALUES", "USING", "FILTER", "GROUP"):
                stop = _closing(tokens, j)
                text, taken = _call(t.text, tokens[j + 1 : stop], tokens[stop + 1 :])
                out.append(text)
                i = stop + taken
            else:
                out.append(t.text)
        else:
            out.append(t.text)
        i += 1
    return "".join(out)


def to_spark(sql: str) -> str:
    """Rule SQL in Spark's dialect; raises SqlTextError for what Spark lacks."""
    return _rewrite(tokenize(strip_semicolon(sql))).strip()


def first_word(sql: str) -> str:
    tokens = [t for t in tokenize(sql) if t.kind not in ("space", "comment") and t.text != "("]
    return tokens[0].upper if tokens else ""
