"""SentencePiece BPE encoding and decoding through a table of each prefix's last token.

A text is escaped as the library does (a leading space, spaces as U+2581) and cut where no piece can reach:
before a U+2581 that follows another character, and around line ends that occur in no piece. Within such a
chunk every prefix has one last token: of the pieces that an automaton finds ending there, the one that is
the whole prefix or whose pair with the last token of the prefix before it is left as it is by merging. The
table holds that token per position, and the ids are read from its end backwards. Characters that are no
piece become their bytes' ids. Pair tests and whole short chunks are remembered in each Python worker, in
tables of bounded size.

Runs of two or more spaces form pieces of equal score, which the table's argument doesn't cover; a chunk that
starts with such a run is merged step by step from a heap instead, in the library's order.

Defined results: a null text counts as empty, and has the end id alone; repeated rows, null ids and extra
columns are kept as they are; columns named like the new ones are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_batches, released, widened

MARK = "▁"
CACHE = 120_000
PAIRS = 500_000
SHORT = 48


@dataclass
class Vocabulary:
    """What a model file says: pieces by id, scores of those that merge, ids of bytes, the end id."""

    pieces: list[str]
    scores: dict[str, float]
    ids: dict[str, int]
    byte_ids: list[int]
    end: int
    whole: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        pieces = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(sp.is_byte(i) for i in byte_ids):
            raise ValueError("the model has no byte pieces")
        if any(MARK in pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("a piece crosses a space")
        v = cls(pieces, {pieces[i]: sp.get_score(i) for i in plain}, {pieces[i]: i for i in plain}, byte_ids, sp.eos_id())
        v.whole = [p for p in v.scores if len(p) == 1 or v.merge(p) == [p]]
        return v

    def merge(self, text: str, seen: Callable[[str, int, bool], object] | None = None) -> list[str]:
        """Merges the pair of highest score, the leftmost of equals, until none is a piece.

        seen gets each merged part, its start, and whether it ends the text.
        """
        n, score = len(text), self.scores
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        part: list[str] = list(text)
        heap: list[tuple[float, int, int, str]] = []

        def push(i: int, j: int) -> None:
            joined = part[i] + part[j]
            if (s := score.get(joined)) is not None:
                heap.append((-s, i, j, joined))

        for i in range(n - 1):
            push(i, i + 1)
        heapq.heapify(heap)
        while heap:
            _, i, j, joined = heapq.heappop(heap)
            if not part[i] or not part[j] or right[i] != j or part[i] + part[j] != joined:
                continue
            part[i], part[j] = joined, ""
            right[i] = right[j]
            if seen:
                seen(joined, i, right[i] >= n)
            if right[i] < n:
                left[right[i]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b < n:
                    both = part[a] + part[b]
                    if (s := score.get(both)) is not None:
                        heapq.heappush(heap, (-s, a, b, both))
        return [p for p in part if p]


class _Chunks(dict):
    """Remembered chunks, with those of the table before."""

    def __init__(self, coder: Coder, prefix: str) -> None:
        super().__init__()
        self.coder, self.prefix, self.old = coder, prefix, {}

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            found = self._cut(word) or self.coder.chunk(self.prefix + word)
            if len(word) > SHORT:
                return found
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[word] = found
        return found


    def _cut(self, word: str) -> bytes | None:
        """A word with a border that no piece crosses, from its parts."""
        pairs = self.coder.within
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in pairs]
        if not cuts:
            return None
        parts = [word[i:j] for i, j in zip([0, *cuts], [*cuts, len(word)])]
        return b"".join([self[parts[0]], *[self.coder.bare[p] for p in parts[1:]]])


class Coder:
    """Encodes and decodes with a vocabulary; one per Python worker."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for p in vocabulary.whole:
            self.automaton.add_word(p, (vocabulary.ids[p], len(p)))
        self.automaton.make_automaton()
        self.within = {p[i : i + 2] for p in vocabulary.scores for i in range(len(p) - 1)}
        self.pairs: dict[int, bool] = {}
        self.edges: dict[int, tuple[list[str], list[str]]] = {}
        self.spaced, self.bare = _Chunks(self, MARK), _Chunks(self, "")
        self.line_end = not any("\n" in p for p in vocabulary.scores)
        self.raw = [b"" if i == vocabulary.end else p.replace(MARK, " ").encode() for i, p in enumerate(vocabulary.pieces)]
        for b, i in enumerate(vocabulary.byte_ids):
            self.raw[i] = bytes([b])

    def fits(self, a: int, b: int) -> bool:
        """Whether merging leaves pieces a and b apart when they are neighbours."""
        key = a << 24 | b
        found = self.pairs.get(key)
        if found is None:
            x, y = self.v.pieces[a], self.v.pieces[b]
            score = self.v.scores
            # without a piece across the border at any stage there is nothing to merge
            found = not any(r + q in score for r in self._edges(a)[1] for q in self._edges(b)[0]) or self.v.merge(x + y) == [x, y]
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[key] = found
        return found

    def _edges(self, piece: int) -> tuple[list[str], list[str]]:
        """What stands leftmost and rightmost in a piece while it is merged."""
        found = self.edges.get(piece)
        if found is None:
            text = self.v.pieces[piece]
            first, last = {text[0], text}, {text[-1], text}
            self.v.merge(text, lambda part, at, end: (first.add(part) if at == 0 else None, last.add(part) if end else None))
            found = self.edges[piece] = (list(first), list(last))
        return found

    def table(self, text: str) -> list[int]:
        """Ids of a chunk without runs of spaces, by the last tokens of its prefixes."""
        last, size = [-1] * (len(text) + 1), [1] * (len(text) + 1)
        pairs = self.pairs
        done = 0
        for at, (piece, n) in self.automaton.iter(text):
            at += 1
            if at == done:
                continue
            start = at - n
            if start:
                before = last[start]
                if before >= 0:
                    ok = pairs.get(before << 24 | piece)
                    if not (self.fits(before, piece) if ok is None else ok):
                        continue
            last[at], size[at], done = piece, n, at
        out: list[int] = []
        at = len(text)
        while at:
            if last[at] >= 0:
                out.append(last[at])
            else:
                out.extend(self.v.byte_ids[b] for b in reversed(text[at - 1].encode()))
            at -= size[at]
        return out[::-1]

    def chunk_ids(self, text: str) -> list[int]:
        if text.startswith(MARK * 2):
            out: list[int] = []
            for p in self.v.merge(text):
                out.extend([self.v.ids[p]] if p in self.v.ids else [self.v.byte_ids[b] for b in p.encode()])
            return out
        return self.table(text)

    def chunk(self, text: str) -> bytes:
        """A chunk's ids as 4 bytes each."""
        return array("i", self.chunk_ids(text)).tobytes()

    def pieces(self, ids: list[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))

    def _line(self, line: str, first: bool) -> list[bytes]:
        parts = line.split(" ")
        if "" not in parts:
            spaced = self.spaced
            if first:
                return [spaced[w] for w in parts]
            return [self.bare[parts[0]], *[spaced[w] for w in parts[1:]]]
        out, marks = [], int(first)
        for k, w in enumerate(parts):
            marks += k > 0
            if w:
                out.append(self.bare[w] if not marks else self.spaced[w] if marks == 1 else self.chunk(MARK * marks + w))
                marks = 0
        if marks:
            out.append(self.spaced[""] if marks == 1 else self.chunk(MARK * marks))
        return out

    def encode(self, text: str) -> tuple[np.ndarray, bytes]:
        """All ids, the end id last, and the bytes that they decode to."""
        if not text:
            return np.array([self.v.end], np.int32), b""
        text = text.replace(MARK, " ")
        found: list[bytes] = []
        for k, line in enumerate(text.split("\n") if self.line_end else [text]):
            if k:
                found.append(self.bare["\n"])
            if line or not k:
                found.extend(self._line(line, first=not k))
        ids = np.frombuffer(b"".join(found), np.int32)
        return np.append(ids, np.int32(self.v.end)), self.pieces(ids.tolist())[1:]

    def forget(self) -> None:
        """Drops what is remembered of chunks and pairs."""
        self.pairs.clear()
        for chunks in (self.spaced, self.bare):
            chunks.old = {}
            chunks.clear()

    def decode(self, ids: list[int]) -> str:
        """As the library: pieces joined, bytes read as UTF-8, the added space taken off, control ids left out."""
        raw = self.pieces([i for i in ids if i != self.v.end])
        return raw[raw.startswith(b" ") :].decode("utf-8", "replace")


_coders: dict[int, Coder] = {}


def _coder(shared) -> Coder:  # noqa: ANN001
    if shared.id not in _coders:
        _coders.clear()
        _coders[shared.id] = Coder(shared.value)
    return _coders[shared.id]


class _Shared:
    """A broadcast vocabulary with a name that is its own."""

    def __init__(self, spark, vocabulary: Vocabulary) -> None:  # noqa: ANN001
        self.broadcast = spark.sparkContext.broadcast(vocabulary)
        self.id = hash((len(vocabulary.pieces), "\0".join(vocabulary.pieces), vocabulary.end))

    @property
    def value(self) -> Vocabulary:
        return self.broadcast.value


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """docs with ids (array of int, the end id last) and decoded (what the ids decode to)."""
    arrow_batches(docs.sparkSession)
    docs = docs.drop("ids", "decoded")
    at = docs.columns.index(text_col)
    shared = _Shared(docs.sparkSession, Vocabulary.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for b in batches:
            done = [coder.encode(t or "") for t in b.column(at).to_pylist()]
            ends = np.cumsum([0, *[len(x[0]) for x in done]]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([x[0] for x in done]) if done else np.empty(0, np.int32)))
            text = pa.array([x[1].decode("utf-8", "replace") for x in done], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, ids, text], names=[*b.schema.names, "ids", "decoded"])
        coder.forget()

    return docs.mapInArrow(lambda it: released(run(it)), widened(docs, ids="array<int>", decoded="string"))


def decode(df: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """df with decoded, the text of each row's ids; null ids give null."""
    arrow_batches(df.sparkSession)
    df = df.drop("decoded")
    at = df.columns.index(ids_col)
    shared = _Shared(df.sparkSession, Vocabulary.load(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared)
        for b in batches:
            text = [None if x is None else coder.decode([i for i in x if i is not None]) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*b.schema.names, "decoded"])

    return df.mapInArrow(run, widened(df, decoded="string"))
