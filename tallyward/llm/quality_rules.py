"""Quality rules: line-first cleaning.

Every line is judged by itself (symbols, shouting, navigation, boilerplate,
repetition). Failing lines leave the text; a document that loses too large a
share of its words is rejected. Everything is linear in the text and looks at
one document at a time, so there is no shuffle.

Defined cases: a null text counts as empty; an empty text has no words, so it
fails the base check and is rejected; repeated rows are judged alike and all
come out; input columns other than the two named are never touched, so their
names cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import require

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(set(range(256)) - set(SYMBOLS))
_NOT_UPPER = bytes(set(range(256)) - set(range(65, 91)))
_NOT_LETTER = bytes(set(range(256)) - set(range(65, 91)) - set(range(97, 123)))
#: UTF-8 continuation bytes; what is left counts code points.
_CONTINUATION = bytes(range(0x80, 0xC0))
_SPACES = b" \t\n\x0b\x0c\r"

# Bare words that separate menu entries.
SEPARATORS = ("|", "/", ">", ">>", "»", "·", "•", "-", "–")

# Phrases of boilerplate lines, in lower case.
BOILERPLATE = (
    "accept all cookies",
    "all rights reserved",
    "back to top",
    "click here",
    "cookie policy",
    "enable javascript",
    "log in to",
    "permission is hereby granted",
    "licensed under the",
    "privacy policy",
    "read more",
    "released under the",
    "share this",
    "sign up for",
    "skip to content",
    "subscribe to our",
    "terms of service",
    "terms of use",
)
_BOILERPLATE = re.compile(b"|".join(re.escape(p.encode()) for p in BOILERPLATE))
_SEPARATORS = {s.encode() for s in SEPARATORS}


@dataclass(frozen=True)
class LineRules:
    """Limits, as whole percentages; integer arithmetic keeps them exact."""

    #: symbols per 100 characters of words
    symbol_percent: int = 10
    #: exclamation marks per 100 characters of words
    exclamation_percent: int = 8
    #: upper-case letters per 100 ASCII letters, for lines of at least shout_words
    upper_percent: int = 60
    shout_words: int = 5
    #: bare separators per 100 words, for lines with at least two of them
    separator_percent: int = 20
    #: a phrase makes a line boilerplate up to this many words
    boilerplate_words: int = 40
    #: of 100 words, so many may be lost
    lost_percent: int = 40
    #: base check
    least_words: int = 50
    repeat_percent: int = 50


def line_fault(line: bytes, words: list[bytes], rules: LineRules) -> str:
    """Name of the first rule that a line with words fails, or ''."""
    solid = line.translate(None, _SPACES)
    chars = len(solid.translate(None, _CONTINUATION))
    if 100 * len(line.translate(None, _NOT_SYMBOLS)) > rules.symbol_percent * chars:
        separators = sum(w in _SEPARATORS for w in words)
        if separators >= 2 and 100 * separators >= rules.separator_percent * len(words):
            return "navigation"
        return "punctuation"
    if 100 * line.count(b"!") > rules.exclamation_percent * chars:
        return "punctuation"
    if len(words) >= rules.shout_words:
        letters = len(line.translate(None, _NOT_LETTER))
        if 100 * len(line.translate(None, _NOT_UPPER)) > rules.upper_percent * letters:
            return "shouting"
    separators = sum(w in _SEPARATORS for w in words)
    if separators >= 2 and 100 * separators >= rules.separator_percent * len(words):
        return "navigation"
    if len(words) <= rules.boilerplate_words and _BOILERPLATE.search(line.lower()):
        return "boilerplate"
    return ""


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered = reach = 0
    for i, window in enumerate(windows):
        if seen[window] > 1:
            covered += i + 3 - max(reach, i)
            reach = i + 3
    return covered


def judge(text: str | None, rules: LineRules = LineRules()) -> dict:
    """All measures of one text, its verdict and what is left of it."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    out = {
        "n_words": n,
        "word_chars": len(data.translate(None, _SPACES).translate(None, _CONTINUATION)),
        "n_symbols": len(data.translate(None, _NOT_SYMBOLS)),
        "n_repeat_words": repeated_words(words),
    }
    seen: set[bytes] = set()
    left: list[bytes] = []
    faults: Counter = Counter()
    duplicates = lost = 0
    for line in data.split(b"\n"):
        own = line.split()
        if not own:
            left.append(line)
            continue
        if line in seen:
            duplicates += 1
            fault = "repetition"
        else:
            seen.add(line)
            fault = line_fault(line, own, rules)
        if fault:
            faults[fault] += 1
            lost += len(own)
        else:
            left.append(line)
    base_failed = n < rules.least_words or 100 * out["n_repeat_words"] > rules.repeat_percent * n
    out |= {
        "n_dup_lines": duplicates,
        "base_failed": base_failed,
        "kept": not base_failed and 100 * lost <= rules.lost_percent * n,
        "n_lost_words": lost,
        "clean_text": b"\n".join(left).decode("utf-8", "surrogatepass"),
    }
    for name in ("punctuation", "shouting", "navigation", "boilerplate", "repetition"):
        out[f"lines_{name}"] = faults[name]
    return out


_TYPES = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
    "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "n_lost_words": "long",
    "lines_punctuation": "long", "lines_shouting": "long", "lines_navigation": "long",
    "lines_boilerplate": "long", "lines_repetition": "long", "clean_text": "string",
}


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """One row per document: its id, measures, verdict and, if asked for, the cleaned text."""
    require(docs, id_col, text_col)
    types = {k: v for k, v in _TYPES.items() if with_text or k != "clean_text"}
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{k} {v}" for k, v in types.items())
    kinds = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t.as_py(), rules) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([f[k] for f in found], kinds[v]) for k, v in types.items())],
                names=["doc_id", *types],
            )

    return narrow.mapInArrow(run, schema)


def quality_filter(docs: DataFrame, text_col: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """The documents that pass, with all their columns, their text cleaned and n_chars, if there, up to date."""
    require(docs, text_col)
    names, at = docs.columns, docs.columns.index(text_col)
    chars = names.index("n_chars") if "n_chars" in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t.as_py(), rules) for t in batch.column(at)]
            kept = [i for i, f in enumerate(found) if f["kept"]]
            part = batch.take(pa.array(kept, pa.int64()))
            columns = list(part.columns)
            columns[at] = pa.array([found[i]["clean_text"] for i in kept], columns[at].type)
            if chars >= 0:
                columns[chars] = pa.array([len(found[i]["clean_text"]) for i in kept], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, docs.schema)
