"""Personal data: base patterns, and spans added by weak supervision.

Four kinds have base patterns whose matches always stand: email, ip, card and
phone. Further candidates (secrets, phones without a country sign, cards and phones
that run into other numbers, spelled-out addresses, account and identity
numbers) come from wide patterns. On each
candidate five labelers vote for, against or not at all: pattern, gazetteer of
words before it, context, character mix and checksum. Expectation-maximisation
estimates how reliable each labeler is for each kind, from the counts of vote
patterns over all documents; a logistic span classifier is then trained on the
resulting probabilities, with features that the labelers lack (length, digits, shape, what
follows), and decides which candidates become spans.

Vote patterns are a closed set of small size whatever the input, so what
reaches the driver is bounded, and one pass over the texts is enough.

Defined cases: a null text counts as empty and has no spans; offsets are code
points, end exclusive; a candidate that overlaps a base span is dropped unless
it contains the span; repeated rows give equal rows; an empty table gives an
empty result, and a model without candidates accepts by the labelers' prior
reliability; columns other than those named are never touched.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import require, settle

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "secret", "ssn")
KINDS = BASE + ADDED

# Base patterns. An ip or card can only begin at the start of a run of digits, so none is tried inside one;
# an email is looked for around its @. Both find what leftmost matching finds, in linear time.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SEPARATORS = {ord(c): None for c in " ().-+"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Matches of the base patterns that pass their checks, leftmost and non-overlapping within each kind."""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    end = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out["email"].append((start, end))
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = m[0].translate(_SEPARATORS) if m.end() - m.start() <= 40 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(m[0].translate(_SEPARATORS)) <= 15:
                out["phone"].append(m.span())
    return out


# A secret is a whole run of its characters, however long, with a digit anywhere in it.
_WIDE = (
    ("secret", re.compile(r"(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{16,}+")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")),
    ("ssn", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z])\+?(?:[0-9]{1,3} ?)?\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{2,4}\) ?|0)[0-9][0-9 .-]{5,14}[0-9](?![0-9A-Za-z-])")),
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z0-9-]{1,63}){1,4}(?![A-Za-z0-9-])")),
)

# Words before a span that speak for its kind, in lower case.
GAZETTEER = {
    "card": frozenset("card carte credit debit karte mastercard pay payment tarjeta visa".split()),
    "email": frozenset("address contact email mail write".split()),
    "iban": frozenset("account bank iban konto cuenta compte".split()),
    "phone": frozenset("call cell fax mobile phone tel telefon telephone teléfono téléphone".split()),
    "secret": frozenset("access api apikey auth bearer credential key passwd password private pwd secret token".split()),
    "ssn": frozenset("identity security social ssn".split()),
}
# Words before a span that speak against it.
AGAINST = frozenset("article chapter commit doi figure isbn issn issue md5 order page part revision section sha1 sha256 table url version volume".split())
_WORDS = re.compile(r"[^\W\d_]+")
_DIGIT = re.compile(r"[0-9]")


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values())


def _iban_valid(span: str) -> bool:
    plain = span.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """For (1), against (-1) or no vote (0) of each labeler: pattern, gazetteer, context, mix, checksum."""
    span = text[start:end]
    before = text[max(0, start - 40) : start]
    words = [w.lower() for w in _WORDS.findall(before)][-3:]
    digits = sum(c.isdigit() for c in span)
    pattern = mix = checksum = 0
    if kind == "secret":
        plain = span.strip("=_-/+")
        pattern = 1 if re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}|(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk[-_][A-Za-z0-9_-]{20,}|eyJ[A-Za-z0-9_-]{20,}", plain) else 0
        if digits == len(plain) or "/" in span and digits * 6 < len(span):
            pattern = -1
        mix = 1 if _entropy(span) >= 3.2 and digits * 10 >= len(span) and digits < len(span) else -1
    elif kind == "card":
        checksum = 1 if luhn(span.translate(_SEPARATORS)) else -1
        mix = 1 if span[0] in "3456" else -1
    elif kind == "iban":
        checksum = 1 if _iban_valid(span) else -1
        pattern = 1 if len(span.replace(" ", "")) >= 18 else 0
    elif kind == "ssn":
        a, b, c = span.split("-")
        pattern = -1 if a in ("000", "666") or a[0] == "9" or b == "00" or c == "0000" else 1
    elif kind == "phone":
        pattern = 1 if "(" in span else 0
        mix = 1 if 9 <= digits <= 12 else -1
    elif kind == "email":
        pattern = 1
        mix = 1 if re.search(r"[A-Za-z]{2,}\W*\Z", span) else -1
    gazetteer = 1 if GAZETTEER[kind].intersection(words) else -1 if AGAINST.intersection(words) else 0
    tail = before.rstrip(" \"'`")
    context = 1 if tail.endswith(("=", ":", "=>")) else -1 if tail.endswith(("/", "#", "&", "?")) and tail == before else 0
    return pattern, gazetteer, context, mix, checksum


def shape(text: str, start: int, end: int) -> tuple[int, int]:
    """What no labeler looks at: the mix of letters and separators of a span (0 to 7), and what follows it (0 to 2)."""
    span = text[start:end]
    mixed = any(c.islower() for c in span) + 2 * any(c.isupper() for c in span) + 4 * (not span.isalnum())
    after = text[end : end + 1]
    return mixed, 0 if not after or after.isspace() else 1 if after in ".,;:!?)\"']" else 2


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, vote pattern) of what the wide patterns find."""
    taken: list[list[int]] = []  # base spans, those that overlap as one
    for x, y in sorted(s for spans in base.values() for s in spans):
        if taken and x < taken[-1][1]:
            taken[-1][1] = max(y, taken[-1][1])
        else:
            taken.append([x, y])
    out = []
    for kind, pattern in _WIDE:
        if kind == "email" and "at" not in text and "AT" not in text:
            continue
        for m in pattern.finditer(text):
            if kind == "secret" and not _DIGIT.search(m[0]):
                continue
            a, b = m.span()
            i = bisect.bisect_right(taken, a, key=lambda t: t[1])
            hits = i < len(taken) and taken[i][0] < b
            if hits and (kind != "secret" or taken[i][0] < a or taken[i] == [a, b]):
                continue
            j = bisect.bisect_left(taken, b, lo=i, key=lambda t: t[0]) - 1
            if hits and taken[j][1] > b:
                continue
            cast = votes(kind, text, a, b)
            digits = sum(c.isdigit() for c in m[0])
            length = min(3, (b - a) // 16)
            share = min(3, 4 * digits // (b - a))
            out.append((kind, a, b, f"{kind} " + " ".join(map(str, (*cast, length, share, *shape(text, a, b))))))
    return out


#: Values of the features that follow the votes in a pattern: length, digits, shape, what follows.
FEATURES = (4, 4, 8, 3)


@dataclass(frozen=True)
class SpanModel:
    accepted: frozenset[str]  # vote patterns
    reliability: dict[str, list[float]]  # of each kind: of each labeler


def fit_spans(patterns: dict[str, int], rounds: int = 50, least: float = 0.5) -> SpanModel:
    """EM over vote patterns, then a logistic classifier on votes and features of the span, trained to its probabilities."""
    accepted: set[str] = set()
    reliability: dict[str, list[float]] = {}
    for kind in sorted({p.split()[0] for p in patterns}):
        own = sorted(p for p in patterns if p.split()[0] == kind)
        n = np.array([patterns[p] for p in own], float)
        x = np.array([[int(v) for v in p.split()[1:]] for p in own])
        cast = x[:, :5]
        right, prior = np.full(5, 0.8), 0.5
        for _ in range(rounds):
            odds = np.log(prior / (1 - prior)) + cast @ np.log(right / (1 - right))
            q = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
            agree = (n[:, None] * (np.where(cast > 0, q[:, None], 0) + np.where(cast < 0, 1 - q[:, None], 0))).sum(0)
            voted = (n[:, None] * (cast != 0)).sum(0)
            right = np.clip((agree + 16) / (voted + 20), 0.55, 0.99)  # a prior of 20 votes, 16 of them right
            prior = float(np.clip(((n * q).sum() + 5) / (n.sum() + 10), 0.05, 0.95))
        reliability[kind] = right.tolist()
        # The classifier starts from nothing and sees length, digits, shape and what follows beside the votes.
        features = np.concatenate([cast, *(np.eye(size)[x[:, 5 + i]] for i, size in enumerate(FEATURES[: x.shape[1] - 5])), np.ones((len(own), 1))], axis=1)
        w, share = np.zeros(features.shape[1]), n / n.sum()
        for _ in range(500):
            p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
            w -= 0.5 * (features.T @ (share * (p - q)) + 1e-3 * w)
        p = 1 / (1 + np.exp(-features @ w))
        accepted.update(pattern for pattern, y in zip(own, p) if y >= least)
    return SpanModel(frozenset(accepted), reliability)


def _joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


_FOUND = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pattern", pa.string())])
_SCANNED = "base string, candidates array<struct<kind:string,start:bigint,end:bigint,pattern:string>>"


def _scanned(docs: DataFrame, text_at: int, keep: list[int]) -> DataFrame:
    """The kept columns, base spans (joined) and candidates of every document."""
    names = [f"c{i}" for i in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, more = [], []
            for text in batch.column(text_at):
                own = base_spans(t := text.as_py() or "")
                base.append(_joined((k, a, b) for k, spans in own.items() for a, b in spans))
                more.append([dict(zip(("kind", "start", "end", "pattern"), c)) for c in candidates(t, own)])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(base, pa.string()), pa.array(more, pa.list_(_FOUND))], names=[*names, "base", "candidates"])

    kinds = [docs.schema[i].dataType.simpleString() for i in keep]
    return docs.mapInArrow(run, ", ".join([*(f"{n} {k}" for n, k in zip(names, kinds)), _SCANNED]))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base spans (joined) and candidates of every document."""
    require(docs, id_col, text_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return _scanned(narrow, 1, [0]).withColumnRenamed("c0", "doc_id")


def fit(scanned: DataFrame) -> SpanModel:
    """The span model from the vote patterns of all candidates; there are at most 6 * 3**5 * 384 of them."""
    counts = scanned.select(F.explode("candidates.pattern").alias("pattern")).groupBy("pattern").count().collect()
    return fit_spans({r["pattern"]: r["count"] for r in counts})


def resolve(scanned: DataFrame, model: SpanModel) -> DataFrame:
    """doc_id, counts and hash of base spans, and all spans."""
    shared = scanned.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepted = shared.value.accepted
        for batch in batches:
            rows = []
            for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                own = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in base.split(","))] if base else []
                count = Counter(k for k, _, _ in own)
                spans = {*own, *((c["kind"], c["start"], c["end"]) for c in more if c["pattern"] in accepted)}
                rows.append((*(count[k] for k in BASE), hashlib.sha256(base.encode()).hexdigest(), _joined(spans)))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), pa.array(columns[4], pa.string()), pa.array(columns[5], pa.string())],
                names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"],
            )

    kind = scanned.schema["doc_id"].dataType.simpleString()
    return scanned.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All personal data of all documents; the texts are read once."""
    scanned = settle(scan(docs, id_col, text_col))
    return resolve(scanned, fit(scanned))


def masked(text: str, spans: Iterable[tuple[int, int, str]]) -> str:
    """The text with every span (start, end, kind) replaced by its kind in angle brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for a, b, k in sorted(spans):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def mask(text: str, accepted: frozenset[str]) -> str:
    """A text with its base spans and accepted candidates masked."""
    base = base_spans(text)
    spans = [(a, b, k) for k, own in base.items() for a, b in own]
    return masked(text, spans + [(a, b, k) for k, a, b, pattern in candidates(text, base) if pattern in accepted])


def redact(docs: DataFrame, model: SpanModel | None = None, text_col: str = "text") -> DataFrame:
    """All documents with personal data masked and n_chars, if there, up to date; no other column changes.

    Texts are scanned once; what was found is kept beside them until the model is fitted.
    """
    require(docs, text_col)
    names, at = docs.columns, docs.columns.index(text_col)
    chars = names.index("n_chars") if "n_chars" in names else -1
    scanned = _scanned(docs, at, list(range(len(names))))
    if model is None:
        scanned = settle(scanned)
        model = fit(scanned)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        accepted = shared.value.accepted
        for batch in batches:
            columns = list(batch.columns[: len(names)])
            texts = columns[at].to_pylist()
            for i, (base, more) in enumerate(zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist())):
                if base or more:
                    spans = [(int(a), int(b), k) for k, a, b in (s.split(":") for s in base.split(","))] if base else []
                    spans += [(c["start"], c["end"], c["kind"]) for c in more if c["pattern"] in accepted]
                    texts[i] = masked(texts[i], spans)
            columns[at] = pa.array(texts, columns[at].type)
            if chars >= 0:
                columns[chars] = pa.array([None if t is None else len(t) for t in texts], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return scanned.mapInArrow(run, docs.schema)
