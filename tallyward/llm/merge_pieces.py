"""Encoding by merges and decoding, with a sentencepiece model of the merge (BPE) type.

The result of merging is found without merging: the pieces of a text are guessed from the
left, longest first, and a guess stands if the piece is compatible with the one before it.
Two pieces are compatible if, with their merges undone one by one, latest first, no two
symbols that face each other at their border would have been merged before they were
consumed. A place from which no piece fits is marked in a bit field, and the guess before
it is shortened. Longest pieces come from an Aho-Corasick automaton.

Texts are cut where no piece of the vocabulary can reach across: before a space mark that
follows another character (if no piece has one inside), around characters that no piece
has, and between two that no piece has side by side. Cuts of usual length are remembered by each worker, up to a fixed number.

Pieces whose merges are not ordered by rank (a piece that does not rank behind both of its
halves, as runs of spaces with one common score) break the rule of undoing. A cut that
contains one is merged directly, with a heap, which is exact as well.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import struct
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import require

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
NEVER = 1 << 60
#: Cuts and pairs of pieces that a worker remembers, and the longest cut that it does.
REMEMBERED, PAIRS, SHORT = 1 << 20, 1 << 20, 32
#: Characters of a text that are worked on at a time.
WINDOW = 1 << 20
#: Texts of a batch that Python holds as strings at a time, in bytes.
SLICE_BYTES = 32 << 20


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError("not a sentencepiece model")
            value = data[at : at + size]
            at += size
        yield key >> 3, value


class Vocabulary:
    """The tables of a model, of the size of its vocabulary: built once and sent to the workers."""

    def __init__(self, model: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(model):
            if number == 1:
                found = dict(_fields(value))
                pieces.append((found[1].decode(), struct.unpack("<f", found.get(2, bytes(4)))[0], found.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        wanted = {
            "the model is not of the merge type": trainer.get(3) == 2,
            "the model has no byte fallback": bool(trainer.get(35)),
            "the model normalizes texts": not normalizer.get(2) and not normalizer.get(4, 1) and bool(normalizer.get(5, 1)),
            "the model puts spaces behind words": not trainer.get(24),
            "the model has pieces of an unsupported kind": {k for _, _, k in pieces} <= {NORMAL, UNKNOWN, CONTROL, BYTE},
        }
        for message, fine in wanted.items():
            if not fine:
                raise ValueError(message)
        self.prefix = bool(normalizer.get(3, 1))
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.surface = [self._surface(p, k, trainer.get(44, " ⁇ ".encode())) for p, _, k in pieces]
        self.kinds = bytes(k for _, _, k in pieces)

        own = [(p, s, i) for i, (p, s, k) in enumerate(pieces) if k == NORMAL]
        order = {s: r for r, s in enumerate(sorted({s for _, s, _ in own}, reverse=True))}
        self.rank_of = {p: order[s] for p, s, _ in own}
        self.alphabet = {c for p, _, _ in own for c in p}
        names = [p for p, _, _ in own] + sorted(self.alphabet - {p for p, _, _ in own})
        self.number = {p: n for n, p in enumerate(names)}
        self.names = names
        self.ids = [i for _, _, i in own] + [-1] * (len(names) - len(own))  # -1: a character that is no piece of its own
        self._undo()

    @staticmethod
    def _surface(piece: str, kind: int, unknown: bytes) -> bytes:
        if kind == NORMAL:
            return piece.replace(SPACE, " ").encode()
        return unknown if kind == UNKNOWN else bytes([int(piece[1:-1], 16)]) if kind == BYTE else b""

    def _undo(self) -> None:
        """The last merge of each piece, by merging it alone; pieces that merging never makes are left out."""
        n = len(self.names)
        self.rank, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        self.pair: dict[int, int] = {}
        self.made, self.irregular = bytearray(n), bytearray(n)
        for k, name in enumerate(self.names):
            if len(name) == 1:
                self.made[k] = 1
                continue
            symbols, last = self.merge(name)
            if len(symbols) > 1:
                continue
            a, b = self.number[last[0]], self.number[last[1]]
            self.rank[k], self.left[k], self.right[k], self.made[k] = self.rank_of[name], a, b, 1
            self.pair[a * n + b] = k
        shared: dict[int, int] = {}
        for k in range(n):
            if self.left[k] >= 0:
                shared[self.rank[k]] = shared.get(self.rank[k], 0) + 1
        for k in range(n):
            if self.left[k] >= 0:
                self.irregular[k] = shared[self.rank[k]] > 1 or self.rank[k] <= max(self.rank[self.left[k]], self.rank[self.right[k]])
        self.shorter = [-1] * n
        for k, name in enumerate(self.names):
            for size in range(len(name) - 1, 0, -1):
                other = self.number.get(name[:size], -1)
                if other >= 0 and self.made[other]:
                    self.shorter[k] = other
                    break

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """Merge neighbours, best rank first and leftmost among equals, until none can be; and the last merge."""
        symbols: list[str | None] = list(text)
        before, after = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        heap: list[tuple[int, int, int]] = []

        def offer(a: int) -> None:
            b = after[a] if a >= 0 else -1
            if b >= 0:
                both = symbols[a] + symbols[b]
                rank = self.rank_of.get(both)
                if rank is not None:
                    heapq.heappush(heap, (rank, a, len(both)))

        for a in range(len(symbols)):
            offer(a)
        last = None
        while heap:
            _, a, size = heapq.heappop(heap)
            b = after[a]
            if symbols[a] is None or b < 0 or len(symbols[a]) + len(symbols[b]) != size:
                continue
            last = symbols[a], symbols[b]
            symbols[a] += symbols[b]
            symbols[b] = None
            after[a] = after[b]
            if after[b] >= 0:
                before[after[b]] = a
            offer(before[a])
            offer(a)
        return [s for s in symbols if s is not None], last


class Coder:
    """Encodes and decodes with a vocabulary; one for each worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = v = vocabulary
        self.n = len(v.names)
        self.length = [len(x) for x in v.names]
        self.automaton = ahocorasick.Automaton()
        for k, name in enumerate(v.names):
            if v.made[k]:
                self.automaton.add_word(name, (k, len(name) - 1))
        self.automaton.make_automaton()
        letters = "".join(sorted(v.alphabet - {SPACE}))
        inside = "".join("\\" + c if c in "\\]^-[&~|" else c for c in letters)
        apart = not any(SPACE in x.lstrip(SPACE) for x in v.names)
        self.cuts = re.compile(f"{SPACE}*[{inside}]+|{SPACE}+|[^{SPACE}{inside}]" if apart else f"[{SPACE}{inside}]+|[^{SPACE}{inside}]")
        self.apart = apart
        odd = sorted((x for k, x in enumerate(v.names) if v.irregular[k]), key=len)
        least = [x for i, x in enumerate(odd) if not any(y in x for y in odd[:i])]
        self.odd = re.compile("|".join(map(re.escape, least))) if least else None
        pack = struct.Struct("<I").pack
        self.byte_ids = {b: pack(i) for b, i in v.bytes.items()}
        self.coded = [pack(i) if i >= 0 else b"".join(self.byte_ids[b] for b in x.encode()) for x, i in zip(v.names, v.ids)]
        self.neighbours = {x[i : i + 2] for k, x in enumerate(v.names) if v.made[k] for i in range(len(x) - 1)}
        self.memo = _Memo(self._cut)
        self.fit: dict[int, bool] = {}

    def _border_holds(self, a: int, b: int) -> bool:
        """Whether no two symbols that ever face each other between pieces a and b are merged before they are consumed."""
        v = self.v
        rank, until_a, until_b = v.rank, NEVER, NEVER
        while True:
            both = v.pair.get(a * self.n + b)
            if both is not None and rank[both] < until_a and rank[both] <= until_b:  # among equal ranks the left goes first
                return False
            if rank[a] > rank[b]:
                until_a, a = rank[a], v.right[a]
            elif rank[b] >= 0:
                until_b, b = rank[b], v.left[b]
            else:
                return True

    def numbers(self, cut: str) -> list[int]:
        """The pieces of a cut whose characters are all known."""
        v, fit, n = self.v, self.fit, self.n
        length, shorter = self.length, v.shorter
        if self.odd and self.odd.search(cut):
            return [v.number[x] for x in v.merge(cut)[0]]
        longest = [0] * len(cut)
        for end, (k, back) in self.automaton.iter(cut):
            longest[end - back] = k  # later ends are longer
        if len(fit) > PAIRS:
            fit.clear()
        failed = bytearray((len(cut) >> 3) + 1)
        found: list[int] = []
        at, last, guess, stop = 0, -1, longest[0], len(cut)
        while at < stop:
            while guess >= 0:
                end = at + length[guess]
                if not failed[end >> 3] >> (end & 7) & 1:
                    if last < 0:
                        break
                    key = last * n + guess
                    fits = fit.get(key)
                    if fits is None:
                        fits = fit[key] = self._border_holds(last, guess)
                    if fits:
                        break
                guess = shorter[guess]
            if guess >= 0:
                found.append(guess)
                at, last = end, guess
                if at < stop:
                    guess = longest[at]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                guess = found.pop()
                last = found[-1] if found else -1
                at -= length[guess]
        return found

    def _cut(self, cut: str) -> bytes:
        if len(cut) <= SHORT:
            for i in range(len(cut) - 1, max(0, len(cut) - 4), -1):
                if cut[i - 1 : i + 1] not in self.neighbours:  # no piece can reach across
                    return self.memo[cut[:i]] + self.memo[cut[i:]]
        if len(cut) == 1 and cut not in self.v.alphabet:
            return b"".join(self.byte_ids[b] for b in cut.encode("utf-8", "replace"))
        return b"".join([self.coded[k] for k in self.numbers(cut)])

    def windows(self, text: str) -> Iterator[bytes]:
        """The ids of a text without begin and end, as little-endian numbers of 32 bits, some at a time."""
        if not text:
            return
        if self.v.prefix:
            text = SPACE + text
        text = text.replace(" ", SPACE)
        at = 0
        while at < len(text):
            end = self._border(text, at + WINDOW)
            yield b"".join(map(self.memo.__getitem__, self.cuts.findall(text, at, end)))
            at = end

    def _border(self, text: str, at: int) -> int:
        """The first place from at on where a cut ends for sure."""
        while at < len(text):
            here, before = text[at], text[at - 1]
            if here not in self.v.alphabet or before not in self.v.alphabet or self.apart and here == SPACE != before:
                return at
            at += 1
        return len(text)

    def encode(self, text: str | None) -> np.ndarray:
        """All ids of a text, begin and end included."""
        return np.concatenate([[self.v.begin], np.frombuffer(b"".join(self.windows(text or "")), "<u4"), [self.v.end]]).astype("<u4")

    def decode(self, ids: np.ndarray | list[int], first: bool = True) -> bytes:
        """The text of ids, in UTF-8: bytes that form no character become U+FFFD one by one. first: the text begins here."""
        ids = ids if isinstance(ids, list) else ids.tolist()
        parts = list(map(self.v.surface.__getitem__, ids))
        kinds = self.v.kinds
        if self.v.prefix and first:  # one space mark in front is that of encoding
            for i, k in enumerate(ids):
                if kinds[k] != CONTROL:
                    if kinds[k] == NORMAL and parts[i].startswith(b" "):
                        parts[i] = parts[i][1:]
                    break
        text = b"".join(parts)
        try:
            text.decode()
        except UnicodeDecodeError:
            return b"".join(self._mended(ids, parts))
        inner = any(kinds[k] == CONTROL for k in set(ids[1:-1]))  # characters do not go across a control id
        return b"".join(self._mended(ids, parts)) if inner else text

    def _mended(self, ids: list[int], parts: list[bytes]) -> Iterator[bytes]:
        run = b""
        for k, part in zip(ids, parts):
            if self.v.kinds[k] == BYTE:
                run += part
                continue
            if run:
                yield _characters(run)
                run = b""
            yield part
        yield _characters(run)


def _characters(run: bytes) -> bytes:
    out, at = [], 0
    while at < len(run):
        for size in (1, 2, 3, 4):
            try:
                out.append(run[at : at + size].decode())
            except UnicodeDecodeError:
                continue
            at += len(out[-1].encode())
            break
        else:
            out.append("�")
            at += 1
    return "".join(out).encode()


class _Memo(dict):
    """What cuts encode to. When it is half full, what was not asked for since the last time is forgotten."""

    def __init__(self, work):
        super().__init__()
        self.work, self.old = work, {}

    def __missing__(self, cut: str) -> bytes:
        value = self.old.get(cut) or self.work(cut)
        if len(cut) <= SHORT:
            if len(self) >= REMEMBERED // 2:
                self.old = dict(self)
                self.clear()
            self[cut] = value
        return value


def read_vocabulary(path: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary(f.read())


def _texts(column: pa.Array) -> Iterator[str]:
    """Texts, null as empty and bytes that are no UTF-8 as U+FFFD, of which Python holds a bounded part at a time."""
    column = column.cast(pa.large_binary())
    size = max(1, SLICE_BYTES * max(1, len(column)) // max(1, column.nbytes))
    for i in range(0, len(column), size):
        for data in column.slice(i, size).to_pylist():
            yield (data or b"").decode("utf-8", "replace")


def _over_texts(docs: DataFrame, model_path: str, id_col: str, text_col: str, one, kinds: dict[str, tuple[str, pa.DataType]]) -> DataFrame:
    """mapInArrow with one Coder for each task: one(coder, text) gives the columns of kinds."""
    require(docs, id_col, text_col)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))  # of the model's size, not the data's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            columns = list(zip(*(one(coder, t) for t in _texts(batch.column(1))))) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, (_, k) in zip(columns, kinds.values()))], names=["doc_id", *kinds])

    types = ", ".join(f"{name} {kind}" for name, (kind, _) in kinds.items())
    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, {types}")


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids of every text, begin and end included: doc_id, ids array<int>.

    A null text counts as empty and gives begin and end alone, as does an empty one. Texts may be of any length;
    they are worked on in windows. Rows that stand twice or share an id stay rows of their own; further
    columns are ignored, whatever their names; an empty table gives an empty one.
    """
    return _over_texts(docs, model_path, id_col, text_col, lambda coder, text: (coder.encode(text).astype(np.int32),), {"ids": ("array<int>", pa.list_(pa.int32()))})


def decode_documents(tokens: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The text of every list of ids: doc_id, text. A null list counts as empty, null entries and ids outside of the vocabulary are an error."""
    require(tokens, id_col, ids_col)
    narrow = tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<long>").alias("ids"))
    shared = tokens.sparkSession.sparkContext.broadcast(read_vocabulary(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for batch in batches:
            texts = [coder.decode(x.as_py() or []).decode() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Number and checksum of every text's ids, and the checksum of the text that they decode to.

    Rows, nulls and lengths are treated as by encode_documents().
    """

    def one(coder: Coder, text: str) -> tuple[int, str, str]:
        ids, back, n = hashlib.sha256(), hashlib.sha256(), 0
        marks = [np.array([k], "<u4").tobytes() for k in (coder.v.begin, coder.v.end)]
        ids.update(marks[0])
        for part in coder.windows(text):
            numbers = np.frombuffer(part, "<u4")
            ids.update(part)
            back.update(coder.decode(numbers, first=not n))
            n += len(numbers)
        ids.update(marks[1])
        return n + 2, ids.hexdigest(), back.hexdigest()

    kinds = {"n_tokens": ("long", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    return _over_texts(docs, model_path, id_col, text_col, one, kinds)
