"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

For every benchmark item, a window of as many words slides over each document. Windows and items have 64-bit
SimHash fingerprints of their word shingles. Of two fingerprints within the radius, some block of eight bits differs in
at most radius / 8 bits; so the index holds, for each block and each of its 256 values, the set of the items whose block
is that near (the neighbours are enumerated when the index is built). A window's candidates are the union of eight sets,
looked up and never scanned for, so that every item within the radius is found. Candidates are verified by the exact
weighted Jaccard similarity of their shingle multisets.

Two lossless bounds come first, because a similarity of s needs s times the item's shingles in the document:
a document that doesn't share so many of an item's shingles isn't compared with it, and only windows that
hold a shared shingle are. A document is scanned in one pass in numpy; nothing is shuffled. The radius is wide
(24 of 64 bits, five standard deviations above what 0.8 gives), as the verification is exact.

Different item texts are sent to the executors in parts of a bounded size, with one pass over the documents for each; an
index takes some seven times the text of its part.

Defined results: words are runs of bytes other than ASCII white space, in lower case; an item of fewer words than a
shingle is one shingle and is found where its words occur in sequence; of equally similar windows the first counts;
null and empty texts and items match nothing; repeated document rows and repeated items each give their matches; null
ids are kept; very long texts are scanned whole; empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, texts, through_disk, words
from .simhash import fingerprint, shingle_hashes

RADIUS = 24
BLOCKS = 8
BLOCK_BITS = 64 // BLOCKS
PART_BYTES = 4_000_000
PRIME = np.uint64(0x9E3779B97F4A7C15)
MATCHES = "doc_id long, item long, similarity double, start_word int, n_words int"


def _rolled(ids: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k word numbers."""
    n = len(ids) - k + 1
    h = np.zeros(max(0, n), np.uint64)
    for i in range(k if n > 0 else 0):
        h = (h + ids[i : i + n]) * PRIME
        h ^= h >> np.uint64(31)
    return h


def folded(text: bytes) -> list[bytes]:
    """The words of the text in lower case, of all alphabets."""
    return words(text if text.isascii() else text.decode("utf-8", "replace").lower().encode())


def counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(hashes, return_counts=True)


def weighted_jaccard(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two multisets of hashes, each as different ones, ascending, and their counts."""
    _, i, j = np.intersect1d(one[0], two[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(one[1][i], two[1][j]).sum())
    return both / (int(one[1].sum() + two[1].sum()) - both)


class Items:
    """Different benchmark texts (item, text), indexed by their shingles and by blocks of their fingerprints."""

    def __init__(self, rows: list[tuple[int, bytes]], k: int, similarity: float, radius: int) -> None:
        self.k, self.similarity, self.radius = k, similarity, radius
        self.number: dict[bytes, int] = {}
        self.ids: list[int] = []
        self.size: list[int] = []
        self.shingles: list[tuple[np.ndarray, np.ndarray]] = []
        prints, held = [], defaultdict(list)
        for i, text in rows:
            t = folded(text)
            if not t:
                continue
            for w in t:
                self.number.setdefault(w, len(self.number) + 1)
            held[min(k, len(t))].append((len(self.ids), np.unique(_rolled(self._numbers(t), min(k, len(t))))))
            self.ids.append(i)
            self.size.append(len(t))
            self.shingles.append(counted(shingle_hashes(t, k)))
            prints.append(fingerprint(t, k))
        self.prints = np.array(prints, np.int64).view(np.uint64)
        #: by shingle length: the shingles, ascending, and the owners of each from one start to the next
        self.owners: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, parts in held.items():
            h = np.concatenate([x for _, x in parts])
            owner = np.repeat(np.array([n for n, _ in parts], np.int32), [len(x) for _, x in parts])
            order = np.argsort(h, kind="stable")
            keys, start = np.unique(h[order], return_index=True)
            self.owners[size] = keys, np.append(start, len(h)).astype(np.int64), owner[order]
        self.blocks = [self._neighbours(b) for b in range(BLOCKS)]

    def _numbers(self, tokens: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, 0) for w in tokens], np.uint64)

    def _neighbours(self, block: int) -> list[int]:
        """Of each value of a block: the items whose block differs in at most radius / BLOCKS bits, as bits of a number."""
        mine = ((self.prints >> np.uint64(block * BLOCK_BITS)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.uint16)
        return [int.from_bytes(np.packbits(np.bitwise_count(mine ^ np.uint16(v)) <= self.radius // BLOCKS, bitorder="little").tobytes(), "little") for v in range(1 << BLOCK_BITS)]

    def near(self, window: int, among: int) -> Iterator[int]:
        """Items within the radius of a window's fingerprint, of those that `among` has a bit for."""
        found = 0
        for b, sets in enumerate(self.blocks):
            found |= sets[window >> (b * BLOCK_BITS) & ((1 << BLOCK_BITS) - 1)]
        found &= among
        while found:
            n = (found & -found).bit_length() - 1
            found &= found - 1
            if (int(self.prints[n]) ^ window).bit_count() <= self.radius:
                yield n

    def matches(self, text: bytes) -> Iterator[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window of each item that the text holds."""
        tokens = folded(text)
        ids = self._numbers(tokens)
        hits: dict[int, list[int]] = defaultdict(list)
        for size, (keys, start, owner) in self.owners.items():
            if np.count_nonzero(ids) < size:
                continue
            h = _rolled(ids, size)
            at = np.searchsorted(keys, h)
            at[at == len(keys)] = 0
            for p in np.flatnonzero(keys[at] == h).tolist():
                for n in owner[start[at[p]] : start[at[p] + 1]].tolist():
                    hits[n].append(p)
        enough: dict[int, list[int]] = defaultdict(list)
        for n, at in hits.items():
            if len(at) >= self.similarity * int(self.shingles[n][1].sum()) - 1e-9:
                enough[self.size[n]].append(n)
        best: dict[int, tuple[float, int, int]] = {}
        for m, items in sorted(enough.items()):
            among = sum(1 << n for n in items)
            starts: set[int] = {0} if len(tokens) < m else set()
            for p in {p for n in items for p in hits[n]}:
                starts.update(range(max(0, p - m + min(self.k, m)), min(p, len(tokens) - m) + 1))
            for s in sorted(starts):
                part = tokens[s : s + m]
                have = None
                for n in self.near(fingerprint(part, self.k) & (1 << 64) - 1, among):
                    have = have or counted(shingle_hashes(part, self.k))
                    alike = weighted_jaccard(have, self.shingles[n])
                    if alike >= self.similarity and alike > best.get(n, (0.0,))[0]:
                        best[n] = (alike, s, len(part))
        for n, (alike, s, m) in sorted(best.items()):
            yield self.ids[n], alike, s, m


def _scan(docs: DataFrame, items: Items) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(i, *m) for i, t in zip(b.column(0).to_pylist(), texts(b.column(1))) for m in shared.value.matches(t)]
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds)], names=["doc_id", "item", "similarity", "start_word", "n_words"])

    return docs.mapInArrow(run, MATCHES)


def item_texts(benchmark: DataFrame) -> DataFrame:
    """(item, text): the different texts of the benchmark, numbered."""
    return through_disk(benchmark.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").distinct().select(F.monotonically_increasing_id().alias("item"), "text"), "items")


def item_parts(items: DataFrame, k: int, similarity: float, radius: int, part_bytes: int) -> Iterator[Items]:
    """The texts (item, text) in parts of about part_bytes each."""
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()
        if rows:
            yield Items([(r["item"], r["text"].encode()) for r in sorted(rows)], k, similarity, radius)


def find_matches(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = RADIUS, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): each document row's best window for each item that it holds."""
    arrow_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    items = item_texts(benchmark)
    found = [_scan(docs, part) for part in item_parts(items, k, similarity, radius, part_bytes)]
    named = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).join(items, "text").select("item", "item_id")
    matches = reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], MATCHES)
    return matches.join(through_disk(named, "item-names"), "item").select("doc_id", "item_id", "similarity", "start_word", "n_words")


def decontaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, similarity: float = 0.8, radius: int = RADIUS, part_bytes: int = PART_BYTES) -> DataFrame:
    """docs without the rows that hold a benchmark item; all columns are kept."""
    arrow_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for items in item_parts(item_texts(benchmark), k, similarity, radius, part_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for b in batches:
                clean = [next(shared.value.matches(t), None) is None for t in texts(b.column(at))]
                yield b.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
