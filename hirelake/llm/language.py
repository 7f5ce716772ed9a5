"""Language identification with language-bitmask n-gram filters.

Training counts character 3- and 4-grams per language over all labelled texts. A language's set holds the
n-grams whose rate in it is at least RATIO of their highest rate in any language, the most frequent of them where
there are more than the filter has room for: its size is bounded, and no language's slice gets over an eighth full,
so that the false-positive rate stays small for any amount of text. The sets share one
bit-sliced Bloom filter: a table of bit masks, a bit per language, in which an n-gram's masks at its slots
are and-ed, so one probe returns all languages that contain it. A text's hits are summed per language over
all its n-grams and corrected for false positives, (hits - n * rate) / (1 - rate) with the rate taken from
the language's own share of set bits; the language with most corrected hits is predicted, the first in
alphabetical order on a tie.

Defined results: a null text, or one without a letter, is `und` with score 0; a text whose n-grams are in no
set gets the language with most training text and score 0; without any training row all is `und`; repeated
rows and rows with a null id count like any others; very long texts are read whole; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, released, through_disk, widened

ORDERS = (3, 4)
SLOTS_LOG2 = (16, 22)
PROBES = 2
#: An n-gram counts from so many occurrences, in languages that have ENOUGH of such; from one in those of little text.
MIN_COUNT = 4
ENOUGH = 1000
#: Slots for each n-gram of a set, and bytes of the whole filter, which goes to the driver and the tasks.
ROOM = 16
FILTER_BYTES = 1 << 25
BLOCK_LOG2 = 10
RATIO = 0.25
MAX_LANGUAGES = 1024
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SECOND = np.uint64(0xC2B2AE3D27D4EB4F)
CHARS = 1 << 16
FLUSH = 1 << 20
SPACE = 32

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Of each code point: whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, each run of other characters as one space, one at both ends."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letter_table()[points]
    points = np.where(is_letter, points, SPACE)
    points = np.concatenate([[SPACE], points, [SPACE]]).astype(np.uint64)
    gap = points == SPACE
    return points[np.r_[True, ~(gap[1:] & gap[:-1])]]


def grams(points: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams of all orders, repeats included."""
    out = []
    for n in ORDERS:
        h = np.full(max(0, len(points) - n + 1), n, np.uint64)
        for i in range(n):
            h = (h ^ points[i : len(points) - n + 1 + i]) * MULTIPLIER if len(h) else h
            h ^= h >> np.uint64(29)
        out.append(h)
    return np.concatenate(out)


@dataclass
class Filter:
    languages: list[str]
    masks: np.ndarray  # (slots, words of 64 languages)
    rates: np.ndarray
    most_text: int

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Per language, how many of the n-grams its set holds."""
        top = np.uint64(64 - int(np.log2(len(self.masks))))
        total = np.zeros(len(self.languages), np.int64)
        for i in range(0, len(hashes), CHARS):
            h = hashes[i : i + CHARS]
            found = self.masks[(h >> top).astype(np.int64)] & self.masks[((h * SECOND) >> top).astype(np.int64)]
            for k in range(len(self.languages)):
                total[k] += np.count_nonzero(found[:, k // 64] & np.uint64(1 << (k % 64)))
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        if text is None or not self.languages:
            return "und", 0.0
        points = letters(text)
        if (points == SPACE).all():
            return "und", 0.0
        h = grams(points)
        corrected = np.maximum((self.hits(h) - len(h) * self.rates) / (1 - self.rates), 0)
        if corrected.sum() <= 0:
            return self.languages[self.most_text], 0.0
        best = int(corrected.argmax())
        return self.languages[best], float(corrected[best] / corrected.sum())


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n), combined within the task up to FLUSH n-grams at a time."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            g, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
            h = grams(letters(text or ""))
            held.setdefault(lang, []).append(h)
            size += len(h)
            if size >= 2 * FLUSH:
                yield from out()
                held, size = {}, 0
    yield from out()


def train(docs: DataFrame) -> Filter:
    """The filter of all rows (lang, text); lang must not be null."""
    arrow_batches(docs.sparkSession)
    counted = docs.select("lang", "text").mapInArrow(lambda it: released(_count(it)), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = through_disk(counted, "grams")
    found = counted.groupBy("lang").agg(F.sum("n").alias("n"), F.count_if(F.col("n") >= MIN_COUNT).alias("many")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    totals = {r["lang"]: r["n"] for r in found}
    languages = sorted(totals)
    words = max(1, -(-len(languages) // 64))
    if not languages:
        return Filter([], np.zeros((1 << SLOTS_LOG2[0], 1), np.uint64), np.zeros(0), 0)
    spark = docs.sparkSession
    least = {r["lang"]: MIN_COUNT if r["many"] >= ENOUGH else 1 for r in found}
    sums = F.broadcast(spark.createDataFrame([(x, i, float(totals[x] or 1), least[x]) for i, x in enumerate(languages)], "lang string, k int, total double, least int"))
    rated = counted.join(sums, "lang").where(F.col("n") >= F.col("least")).withColumn("rate", F.col("n") / F.col("total"))
    best = rated.groupBy("gram").agg(F.max("rate").alias("best"))
    kept = through_disk(rated.join(best, "gram").where(F.col("rate") >= RATIO * F.col("best")).select("k", "gram", "n"), "kept")
    # a set holds its language's most frequent n-grams, as many as the filter has room for, so that no slice fills up
    level = F.floor(F.log2("n") * 8).cast("int")
    sizes = kept.groupBy("k", level.alias("level")).count().collect()
    most = max(np.bincount([r["k"] for r in sizes], [r["count"] for r in sizes]), default=1)
    top = int(np.log2(FILTER_BYTES // (8 * words)))
    bits = min(max(int(np.ceil(np.log2(max(1, ROOM * most)))), SLOTS_LOG2[0]), SLOTS_LOG2[1], top)
    cuts = []
    for k in range(len(languages)):
        held, cut = 0, 1 << 20
        for n, at in sorted(((r["level"], r["count"]) for r in sizes if r["k"] == k), reverse=True):
            if held and held + at > (1 << bits) // ROOM:
                break
            held, cut = held + at, n
        cuts.append((k, cut))
    chosen = kept.join(F.broadcast(spark.createDataFrame(cuts, "k int, cut int")), "k").where(level >= F.col("cut"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, k = b.column("gram").to_numpy().view(np.uint64), b.column("k").to_numpy()
            at = np.concatenate([h, h * SECOND]) >> np.uint64(64 - bits)
            mask = (np.uint64(1) << (k % 64).astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(np.tile(k // 64, 2).astype(np.int32)), pa.array(np.tile(mask, 2))], names=["slot", "word", "mask"])

    def packed(t: pa.Table) -> pa.Table:
        block = np.zeros(1 << BLOCK_LOG2, np.uint64)
        block[t.column("slot").to_numpy() & ((1 << BLOCK_LOG2) - 1)] = t.column("mask").to_numpy().view(np.uint64)
        return pa.table({"block": t.column("block")[:1], "word": t.column("word")[:1], "masks": pa.array([block.tobytes()], pa.binary())})

    sliced = chosen.select("gram", "k").mapInArrow(slots, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    masks = np.zeros((1 << bits, words), np.uint64)
    for r in sliced.withColumn("block", F.shiftright("slot", BLOCK_LOG2)).groupBy("block", "word").applyInArrow(packed, "block long, word int, masks binary").collect():
        masks[r["block"] << BLOCK_LOG2 : (r["block"] + 1) << BLOCK_LOG2, r["word"]] = np.frombuffer(r["masks"], np.uint64)
    share = np.array([np.count_nonzero(masks[:, k // 64] & np.uint64(1 << (k % 64))) for k in range(len(languages))]) / len(masks)
    return Filter(languages, masks, np.minimum(share**PROBES, 1 - 1e-6), max(range(len(languages)), key=lambda k: (totals[languages[k]] or 0, -k)))


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % modulus == remainder, F.lit(False))


def predict_languages(docs: DataFrame, model: Filter, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score; columns of these names in docs are replaced."""
    arrow_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shared.value.predict(t) for t in b.column(at).to_pylist()]
            new = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=[*b.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, widened(docs, lang_pred="string", score="double"))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, remainder: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row, learned from the rows that aren't held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col, modulus, remainder).alias("held_out"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = train(rows.where(~F.col("held_out") & F.col("lang").isNotNull()))
    return predict_languages(rows.drop("lang"), model).drop("text")
