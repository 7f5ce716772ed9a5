"""Document fingerprints: a homomorphic multiset hash of paragraphs.

A text is the multiset of its lines. Each paragraph is hashed to a wide vector of 272 lanes, and a fingerprint is the sum of its
paragraphs' vectors, lane by lane modulo 2^32. So the order of paragraphs doesn't matter, equal texts have equal fingerprints,
and a paragraph is inserted or deleted by adding or subtracting its vector, without the text. Sums of fingerprints are
fingerprints of collections.

Sixteen lanes are the paragraph's BLAKE2b digest: other multisets of paragraphs have other sums, but for a chance of 2^-512 (the
hash doesn't withstand somebody who looks for such a multiset). The other 256 count its five-word shingles, each with a sign in one
lane, so that the difference of two fingerprints tells how much two texts differ: likeness is 1 - |x - y|^2 / (|x|^2 + |y|^2),
whose expectation is the weighted Dice share of common shingles, with a standard deviation of about 0.07.

Defined results: a null text counts as empty, one empty paragraph; words are runs of bytes other than space and 0x09-0x0D, A-Z
lower-cased; a paragraph of fewer words than a shingle is one shingle, one without words none; equal fingerprints have likeness 1,
others 0 if either has no shingle; below 0 it is 0. A text of any length is read whole; a shingle that recurs over 2^31 times in
one text leaves equality right but not likeness. Repeated rows are kept; null ids come last in the order of documents, rows of
equal ids are ordered by their text's hash, rows alike in both lie in one task, which holds two at a time. Empty tables give no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, released, saved, words

EXACT = 16
LANES = 256
WIDTH = EXACT + LANES
SHINGLE = 5
MIX = np.uint64(0x9E3779B97F4A7C15)
PART_BYTES = 16 << 20
MOST_PARTS = 20_000
SAMPLE_PER_PART = 20


class WordHashes(dict):
    """XXH64 by word; forgets all when it grows large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHashes()


def _rolled(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n word hashes from each start on."""
    h = np.full(len(starts), n, np.uint64)
    for i in range(n):
        h = (h ^ ids[starts + i]) * MIX
        h ^= h >> np.uint64(29)
    return h


def vector(paragraphs: list[bytes]) -> np.ndarray:
    """The sum of the paragraphs' vectors."""
    out = np.zeros(WIDTH, np.uint32)
    if not paragraphs:
        return out
    digests = b"".join([blake2b(p).digest() for p in paragraphs])
    out[:EXACT] = np.frombuffer(digests, "<u4").reshape(-1, EXACT).sum(axis=0, dtype=np.uint32)
    lines = [words(p) for p in paragraphs]
    size = np.array([len(line) for line in lines])
    ids = np.array([_hashes[w] for line in lines for w in line], np.uint64)
    first = np.cumsum(size) - size
    found = [_rolled(ids, first[size == n], n) for n in range(1, SHINGLE)]
    # a run of five words that ends within its paragraph
    end = np.repeat(first + size, size)
    at = np.arange(len(ids))
    found.append(_rolled(ids, at[at + SHINGLE <= end], SHINGLE))
    h = np.concatenate(found) >> np.uint64(20)
    lane, minus = (h % np.uint64(LANES)).astype(np.int64), (h >> np.uint64(8)) & np.uint64(1) == 1
    counts = np.bincount(lane[~minus], minlength=LANES) - np.bincount(lane[minus], minlength=LANES)
    out[EXACT:] = (counts & 0xFFFFFFFF).astype(np.uint32)
    return out


def of_text(text: str | None) -> np.ndarray:
    return vector((text or "").encode("utf-8", "surrogatepass").split(b"\n"))


def as_string(v: np.ndarray) -> str:
    return v.astype("<u4").tobytes().hex()


def from_string(s: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(s), "<u4").astype(np.uint32)


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    if (x == y).all():
        return 1.0
    a, b, d = (v[EXACT:].view(np.int32).astype(np.float64) for v in (x, y, x - y))
    one, two = float(a @ a), float(b @ b)
    return max(0.0, 1.0 - float(d @ d) / (one + two)) if one and two else 0.0


def _mapped(rows: DataFrame, run, schema: str) -> DataFrame:
    arrow_batches(rows.sparkSession)
    return rows.mapInArrow(lambda batches: released(run(batches)), schema)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([as_string(of_text(t)) for t in b.column(1).to_pylist()], pa.string())], names=["doc_id", "fingerprint"])

    return _mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, fingerprint string")


def updated(edits: DataFrame) -> DataFrame:
    """edits (doc_id, fingerprint, deleted and inserted: arrays of paragraphs) as (doc_id, fingerprint) of the edited texts.

    A null array deletes or inserts nothing, a null paragraph is an empty one; a null fingerprint is that of no paragraph at all.
    """

    def encoded(lines: list[str | None] | None) -> list[bytes]:
        return [(p or "").encode("utf-8", "surrogatepass") for p in lines or []]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for old, gone, new in zip(*(c.to_pylist() for c in b.columns[1:])):
                out.append(as_string((from_string(old) if old else vector([])) - vector(encoded(gone)) + vector(encoded(new))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], names=["doc_id", "fingerprint"])

    return _mapped(edits.select("doc_id", "fingerprint", "deleted", "inserted"), run, "doc_id long, fingerprint string")


def collection_fingerprint(docs: DataFrame, text_col: str = "text") -> str:
    """The fingerprint of all rows' paragraphs together: summed in each task, then lane by lane."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = vector([])
        for b in batches:
            for t in b.column(0).to_pylist():
                total += of_text(t)
        yield pa.RecordBatch.from_arrays([pa.array(range(WIDTH), pa.int32()), pa.array(total.astype(np.int64))], names=["lane", "v"])

    lanes = _mapped(docs.select(F.col(text_col).cast("string").alias("text")), run, "lane int, v long")
    total = vector([])
    for r in lanes.groupBy("lane").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect():
        total[r["lane"]] = int(r["v"]) % (1 << 32)
    return as_string(total)


# --- each document beside the next ----------------------------------------------------------------------------------


def _bounds(keys: DataFrame) -> tuple[list[tuple[int, int]], tuple[int, int] | None]:
    """Keys of rows at which the table is cut into parts of about PART_BYTES, ascending, and the smallest key.

    They are taken from the keys with the smallest hashes, SAMPLE_PER_PART for each part, so that the driver holds a bounded number.
    """
    n_bytes, first = keys.agg(F.sum("bytes"), F.min(F.struct("k0", "k1"))).first()
    if first is None:
        return [], None
    parts = max(1, min(MOST_PARTS, max(n_bytes // PART_BYTES, keys.sparkSession.sparkContext.defaultParallelism)))
    sample = keys.orderBy(F.xxhash64("k0", "k1"), "k0", "k1").limit(parts * SAMPLE_PER_PART).collect()
    rows = sorted((r["k0"], r["k1"], r["bytes"]) for r in sample)
    share, seen, cuts = sum(r[2] for r in rows) / parts, 0, []
    for k0, k1, size in rows:
        if seen >= share * (len(cuts) + 1):
            cuts.append((k0, k1))
        seen += size
    return sorted(set(cuts)), tuple(first)


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """Rows (part, role, k0, k1, doc_id, text) and the number of parts: within a part, ordered by role and key, each row of role 0
    stands before the next document; the first row of role 1 is the one after the part's last.

    Texts are shuffled once. The row at each cut goes to the part before it as well, the first of all to the last part.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    keyed = rows.select(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("k0"), F.xxhash64("text").alias("k1"), "doc_id", "text")
    cuts, first = _bounds(saved(keyed.select("k0", "k1", (F.octet_length("text") + 64).cast("long").alias("bytes"))))
    if first is None:
        return keyed.select(F.lit(0).alias("part"), F.lit(0).alias("role"), "k0", "k1", "doc_id", "text"), 1
    key = F.struct("k0", "k1")

    def whole(k: tuple[int, int]) -> Column:
        return F.struct(F.lit(k[0]).cast("long").alias("k0"), F.lit(k[1]).cast("long").alias("k1"))

    if cuts:
        bound = F.arrays_zip(F.lit([k0 for k0, _ in cuts]).cast("array<long>").alias("k0"), F.lit([k1 for _, k1 in cuts]).cast("array<long>").alias("k1"))
        # how many cuts are not above the key, by halving steps
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(cuts).bit_length()))])
        part = F.aggregate(steps, F.lit(0), lambda p, s: F.when((p + s <= len(cuts)) & (F.get(bound, p + s - 1) <= key), p + s).otherwise(p))
        rows = keyed.withColumn("part", part)
        at_cut = F.get(bound, F.col("part") - 1) == key
    else:
        rows, at_cut = keyed.withColumn("part", F.lit(0)), F.lit(False)
    places = F.array(
        F.struct(F.col("part"), F.lit(0).alias("role")),
        F.when((F.col("part") > 0) & at_cut, F.struct((F.col("part") - 1).alias("part"), F.lit(1).alias("role"))),
        F.when(key == whole(first), F.struct(F.lit(len(cuts)).alias("part"), F.lit(1).alias("role"))),
    )
    placed = rows.select(F.explode(F.filter(places, lambda p: p.isNotNull())).alias("at"), "k0", "k1", "doc_id", "text")
    return placed.select("at.part", "at.role", "k0", "k1", "doc_id", "text"), len(cuts) + 1


def _halved(text: str) -> tuple[str, np.ndarray, np.ndarray, str]:
    """The text but for its last half, its vector, that of the paragraphs before the cut one, and the cut one's beginning."""
    head = text[: len(text) - len(text) // 2]
    start = head.rfind("\n") + 1
    before = vector(text[: start - 1].encode("utf-8", "surrogatepass").split(b"\n")) if start else vector([])
    return head, before + vector(text[start:].encode("utf-8", "surrogatepass").split(b"\n")), before, head[start:]


def edited_by_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per row of docs.

    The edited text is the text with its last half replaced by as much of the next document's beginning. Its fingerprint is that of the
    text less the paragraphs from the cut one on, plus those put in their place.
    """
    rows, parts = beside_next(docs, id_col, text_col)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            out = []
            for part, role, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("part", "role", "doc_id", "text"))):
                if role and held is None:
                    continue
                head, fp, before, cut = _halved(text)
                if held is not None:
                    old_id, old, (old_head, old_fp, old_before, old_cut) = held
                    new = text[: len(old) // 2]
                    edited_fp = old_before + vector((old_cut + new).encode("utf-8", "surrogatepass").split(b"\n"))
                    digest = sha256((old_head + new).encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((old_id, len(old), digest, as_string(old_fp), as_string(edited_fp), likeness(old_fp, edited_fp), likeness(old_fp, fp)))
                held = None if role else (doc_id, text, (head, fp, before, cut))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    ordered = rows.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "role", "k0", "k1")
    return _mapped(ordered, run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
