"""Resampling towards a target distribution: array-scored weights, an exact cutoff by weighted medians of medians.

Features are the runs of one to `longest` consecutive words; a feature's bucket is its CRC-32 modulo a fixed number. Bucket
counts of all documents and of all target texts give each bucket an integer gain, a scaled log ratio of smoothed shares. The
gains are one array of a fixed size that goes to the tasks, and a document's weight is the floored mean of the gains of its
features. Gumbel noise from a hash of the id turns the best scores into a draw without replacement in proportion to the
exponential of the weights (thousandths).

The cutoff is found without a sort of all documents. Chunks of the remaining keys report their median and their size, the
median of these medians, weighted by the sizes, is the pivot, and one pass counts what lies before it; a quarter of the
remaining keys at least lies on either side, so that each pass discards a fixed share until the pivot is the wanted key itself.
Survivors are written anew whenever seven eighths have gone. Only the winners are sorted, by range, and numbered.

Per pass the driver gets one short row per chunk of 2^20 keys and task; counts and gains have the size of the bucket array.

Defined results: null and empty texts have no features and weight 0; a null id is noised like the text \\N and ranks last among
equal scores; repeated rows count, and are drawn, each by itself; rows of equal score and id are ordered by more features
first, then by their place in the scored table; without target texts all gains follow from a target count of zero; an empty
table gives no rows; a text of any length is read whole; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, arrow_rows, released, saved, texts

BUCKETS = 10_000
LONGEST = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
SCALE = 1000
CHUNK_KEYS = 1 << 20
#: 0-9, a-z and all bytes above 0x7F stay, A-Z are lowered, all else parts words.
WORD_BYTES = bytes(ord(c.lower()) if (c := chr(b)).isascii() and c.isalnum() else b if b > 0x7F else 0x20 for b in range(256))
KEY = ["k0", "k1", "k2", "k3"]
Key = tuple[int, ...]


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def feature_buckets(words: list[bytes], longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of every run of 1 to `longest` words; a run's CRC goes on from that of the run without its last word."""
    sums = list(map(crc32, words))
    out = [np.array(sums, np.int64)]
    for n in range(1, longest):
        sums = list(map(crc32, words[n:], map(crc32, repeat(b" "), sums[: len(words) - n])))
        out.append(np.array(sums, np.int64))
    return np.concatenate(out) % buckets


def bucket_counts(df: DataFrame, text_col: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: summed in each task, then by bucket."""
    arrow_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for t in texts(b.column(0)):
                n += np.bincount(feature_buckets(words_of(t), longest, buckets), minlength=buckets)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["bucket", "n"])

    rows = df.select(F.col(text_col).cast("string").alias("text")).mapInArrow(lambda b: released(run(b)), "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(base: np.ndarray, target: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Per bucket the floored, scaled log of the target's smoothed share over the base's."""
    size, all_base, all_target = float(len(base)), float(base.sum()), float(target.sum())
    return np.array([math.floor(scale * math.log(((t + 1.0) * (all_base + size)) / ((s + 1.0) * (all_target + size)))) for s, t in zip(base.tolist(), target.tolist())], np.int64)


def noise(id_col: Column, seed: int = SEED, scale: int = SCALE) -> Column:
    """Floored, scaled Gumbel noise of the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("\\N"))).cast("binary"), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-float(scale)) * F.log(-F.log(share)))


def weighed(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) per row of docs."""
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in batches:
            rows = []
            for t in texts(b.column(1)):
                words = words_of(t)
                at = feature_buckets(words, longest, len(gain))
                rows.append((len(words), len(at), int(gain[at].sum()) // len(at) if len(at) else 0))
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", "n_words", "n_features", "weight"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(lambda b: released(run(b)), "doc_id long, n_words long, n_features long, weight long")
    return rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))


# --- the cutoff -----------------------------------------------------------------------------------------------------


def _before(keys: list[np.ndarray], pivot: Key) -> np.ndarray:
    """Which keys, column by column, are smaller than the pivot."""
    out = np.zeros(len(keys[0]), bool)
    for column, p in zip(reversed(keys), reversed(pivot)):
        out = (column < p) | ((column == p) & out)
    return out


def _median(keys: list[np.ndarray]) -> tuple[int, Key | None]:
    """How many keys there are, and their lower median."""
    n = len(keys[0])
    if not n:
        return 0, None
    at = np.lexsort(keys[::-1])[(n - 1) // 2]
    return n, tuple(int(c[at]) for c in keys)


def _split(keys: DataFrame, low: Key | None, high: Key | None, pivot: Key | None) -> tuple[list[tuple[int, Key]], list[tuple[int, Key]]]:
    """Sizes and medians of each chunk's keys between low and high (both outside): before the pivot, and after it.

    Without a pivot all count as before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            all_keys = [np.concatenate(c) for c in zip(*held)]
            keep = np.ones(len(all_keys[0]), bool)
            if high is not None:
                keep &= _before(all_keys, high)
            if low is not None:
                keep &= ~_before(all_keys, (*low[:-1], low[-1] + 1))
            left = [c[keep] for c in all_keys]
            first = _before(left, pivot) if pivot is not None else np.ones(len(left[0]), bool)
            after = ~_before(left, (*pivot[:-1], pivot[-1] + 1)) if pivot is not None else ~first
            found = [(side, *_median([c[rows] for c in left])) for side, rows in ((0, first), (1, after))]
            found = [f for f in found if f[1]]
            return pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int64()), pa.array([list(f[2]) for f in found], pa.list_(pa.int64()))],
                names=["side", "n", "median"],
            )

        for b in batches:
            held.append([c.to_numpy() for c in b.columns])
            size += b.num_rows
            if size >= CHUNK_KEYS:
                yield out()
                held, size = [], 0
        if size:
            yield out()

    left = keys
    if low is not None:
        left = left.where(F.col(KEY[0]) >= low[0])
    if high is not None:
        left = left.where(F.col(KEY[0]) <= high[0])
    with arrow_rows(keys.sparkSession, 1 << 16):
        rows = left.select(KEY).mapInArrow(run, "side int, n long, median array<long>").collect()
    return [(r["n"], tuple(r["median"])) for r in rows if r["side"] == 0], [(r["n"], tuple(r["median"])) for r in rows if r["side"] == 1]


def _weighted_median(medians: list[tuple[int, Key]]) -> Key:
    half, seen = sum(n for n, _ in medians) / 2, 0
    for n, key in sorted(medians, key=lambda m: m[1]):
        seen += n
        if seen >= half:
            return key
    raise ValueError("no keys")


def cutoff(keys: DataFrame, k: int) -> Key | None:
    """The k-th smallest of the different keys (columns k0 to k3, longs without nulls); None if k is 0 or there are fewer."""
    medians, _ = _split(keys, None, None, None)
    left = written = sum(n for n, _ in medians)
    if not 0 < k <= left:
        return None
    low = high = None
    while True:
        pivot = _weighted_median(medians)
        before, after = _split(keys, low, high, pivot)
        n = sum(m for m, _ in before)
        if k == n + 1:
            return pivot
        if k <= n:
            high, medians, left = pivot, before, n
        else:
            k, low, medians = k - n - 1, pivot, after
            left = sum(m for m, _ in after)
        if left * 8 < written and written > CHUNK_KEYS:
            if low is not None:
                keys = keys.where(F.struct(*KEY) > _key(low))
            if high is not None:
                keys = keys.where(F.struct(*KEY) < _key(high))
            keys, written = saved(keys.select(KEY)), left


def _key(key: Key) -> Column:
    return F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip(key, KEY)])


def drawn(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (doc_id, n_words, n_features, weight, score) with rank: 1, 2, 3... of the floored share drawn, null for all others."""
    keyed = scored.withColumn("k0", -F.col("score")).withColumn("k1", F.coalesce("doc_id", F.lit((1 << 63) - 1))).withColumn("k2", -F.col("n_features"))
    table = saved(keyed.withColumn("k3", F.monotonically_increasing_id()))
    fit = table.where(F.col("n_words") >= least_words)
    last = cutoff(fit, percent * fit.count() // 100)
    if last is None:
        return table.drop(*KEY).withColumn("rank", F.lit(None).cast("long"))
    wins = (F.col("n_words") >= least_words) & (F.struct(*KEY) <= _key(last))
    # the place in the sorted table is its part's number, shifted by 33 bits, and the row's in the part
    winners = saved(table.where(wins).repartitionByRange(*KEY).sortWithinPartitions(*KEY).drop(*KEY).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    starts, seen = [], 0
    for r in sorted(winners.groupBy(part.alias("part")).count().collect()):
        starts += [F.lit(r["part"]), F.lit(seen)]
        seen += r["count"]
    ranked = winners.withColumn("rank", (F.element_at(F.create_map(*starts), part) + F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("place")
    return table.where(~wins).drop(*KEY).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)


def resample(
    docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED, scale: int = SCALE
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) per row of docs, drawn towards the texts of target."""
    gain = gains(bucket_counts(docs, longest=longest, buckets=buckets), bucket_counts(target, longest=longest, buckets=buckets), scale)
    return drawn(weighed(docs, gain, longest=longest, seed=seed), percent, least_words)


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, **how: int) -> DataFrame:
    """The rows of docs that are drawn, whole, with weight, score and rank; docs must have different, non-null ids."""
    won = resample(docs.select("doc_id", "text"), target, percent, **how).where("rank IS NOT NULL")
    return docs.drop("weight", "score", "rank").join(won.select("doc_id", "weight", "score", "rank"), "doc_id")
