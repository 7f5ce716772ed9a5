"""Source divergence audit with late string materialization.

For every language the terms that occur in enough of its documents are its vocabulary. Each source of the language, and the
language itself, has a smoothed share of every term; the audit tells how far each two sources lie apart (the sum of the
differences of shares), and which terms a source uses more than its language does.

Counting shuffles term digests of eight bytes, never the terms: each task counts its digests by group, and Spark sums them. Only
the digests of the vocabulary are then looked up in the texts again, and the smallest and the largest string of each tell whether two terms
share it; such digests are counted anew by their strings and split. Strings are joined to the few rows of the result that name a
term, ties at the last rank included.

Distances of sources are sums over blocks of terms: a task has the shares of two tiles of sources in one block, both of a bounded
size, whatever the language's share of the rows, and gives a partial sum per pair; no pair is made per term.

Defined results: null texts, languages and sources count as empty strings; a group without terms has the smoothed shares of no
counts; without a vocabulary all distances are 0 and no term is listed; repeated rows count by themselves; equal values are ranked by the item's
UTF-8 bytes; a text of any length is read whole; an empty table gives no rows; extra columns are ignored. Counts up to
9 * 10^15 a group are exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_batches, released, saved, texts

LEAST_DOCS = 30
TOP = 50
SCALE = 1_000_000_000
SMOOTH = 5
BLOCK_TERMS = 2048
TILE = 256
HELD_TERMS = 1 << 20
MEMO = 200_000
#: Digests of eight bytes that go to all tasks at most, so that other strings end where they are found.
MOST_SENT = 1 << 20
#: a-z and all bytes above 0x7F stay, A-Z are lowered, all else parts terms.
TERM_BYTES = bytes(ord(c.lower()) if (c := chr(b)).isascii() and c.isalpha() else b if b > 0x7F else 0x20 for b in range(256))
GROUP = ["lang", "source"]
TERM = ["digest", "split"]


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(TERM_BYTES).split()


class Digests(dict):
    """The digest of a term: the lowest `bits` of its XXH64, signed; forgets all when it grows large."""

    def __init__(self, bits: int):
        self.shift = 64 - bits

    def __missing__(self, term: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        x = xxhash.xxh64_intdigest(term) >> self.shift
        self[term] = x = x - (1 << 64) if x >> 63 else x
        return x


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def digest_counts(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(lang, source, digest, n, docs): occurrences, and documents that hold the digest."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests(bits)
        groups: dict[tuple[str, str], int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            group, digest, n = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((digest, group))
            group, digest, n = group[order], digest[order], n[order]
            first = np.flatnonzero(np.concatenate([[True], (group[1:] != group[:-1]) | (digest[1:] != digest[:-1])]))
            names = list(groups)
            at = pa.array(group[first])
            columns = [pa.array([g[i] for g in names], pa.string()).take(at) for i in (0, 1)]
            docs = np.diff(np.append(first, len(group)))
            return pa.RecordBatch.from_arrays([*columns, pa.array(digest[first]), pa.array(np.add.reduceat(n, first)), pa.array(docs)], names=["lang", "source", "digest", "n", "docs"])

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts(b.column(2))):
                found = np.fromiter(map(digests.__getitem__, terms_of(text)), np.int64)
                if not len(found):
                    continue
                different, n = np.unique(found, return_counts=True)
                held.append((np.full(len(different), groups.setdefault((lang, source), len(groups)), np.int32), different, n))
                size += len(different)
                if size >= HELD_TERMS:
                    yield out()
                    held, size = [], 0
                    groups = {}
        if held:
            yield out()

    found = _rows(docs).mapInArrow(lambda b: released(run(b)), "lang string, source string, digest long, n long, docs long")
    return found.groupBy(*GROUP, "digest").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _digested(docs: DataFrame, bits: int) -> DataFrame:
    """(digest, term): each task's different terms, most of them once."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests, seen = Digests(bits), set()
        for b in batches:
            new = set()
            for text in texts(b.column(0)):
                new.update(terms_of(text))
            new -= seen
            if len(seen) >= MEMO:
                seen = set()
            seen |= new
            ordered = sorted(new)
            yield pa.RecordBatch.from_arrays([pa.array([digests[t] for t in ordered], pa.int64()), pa.array(ordered, pa.binary()).cast(pa.string())], names=["digest", "term"])

    return _rows(docs).select("text").mapInArrow(lambda b: released(run(b)), "digest long, term string")


def _term_counts(docs: DataFrame, bits: int) -> DataFrame:
    """(lang, source, digest, term, n): of each document its different terms; for the few digests that are split."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests(bits)
        for b in batches:
            for row, text in enumerate(texts(b.column(2))):
                different, n = np.unique(np.array(terms_of(text), object), return_counts=True)
                if len(different):
                    at = pa.array(np.full(len(different), row))
                    digest = pa.array([digests[t] for t in different], pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(at), b.column(1).take(at), digest, pa.array(different.tolist(), pa.binary()).cast(pa.string()), pa.array(n)], names=["lang", "source", "digest", "term", "n"]
                    )

    return _rows(docs).mapInArrow(lambda b: released(run(b)), "lang string, source string, digest long, term string, n long")


def vocabulary(docs: DataFrame, least_docs: int = LEAST_DOCS, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, source, digest, split, n) of each language's kept terms, and the names (digest, split, term) of all of them.

    `split` is 0 but for digests of several terms, whose terms are numbered from 1.
    """
    counts = saved(digest_counts(docs, bits))

    def kept(rows: DataFrame, *key: str) -> DataFrame:
        return rows.groupBy("lang", *key).agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).select("lang", *key)

    # no term of a digest can be kept where the digest isn't
    wanted = saved(kept(counts, "digest"))
    digests = wanted.select("digest").distinct()
    digests = F.broadcast(digests) if digests.count() <= MOST_SENT else digests
    named = saved(_digested(docs, bits).join(digests, "digest", "left_semi").groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("last")))
    mixed = named.where("term <> last").select("digest")
    plain = counts.join(wanted, ["lang", "digest"], "left_semi")
    names = named.select("digest", F.lit(0).alias("split"), "term")
    if mixed.isEmpty():
        return saved(plain.select(*GROUP, "digest", F.lit(0).alias("split"), "n")), names
    again = _term_counts(docs, bits).join(mixed, "digest", "left_semi").groupBy(*GROUP, "digest", "term").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
    again = saved(again.join(wanted, ["lang", "digest"], "left_semi"))
    terms = saved(again.groupBy("digest", "term").agg(F.lit(1)).select("digest", "term", F.row_number().over(Window.partitionBy("digest").orderBy("term")).alias("split")))
    numbered = again.join(terms, ["digest", "term"])
    numbered = numbered.join(kept(numbered, "digest", "split"), ["lang", "digest", "split"], "left_semi")
    pure = plain.join(mixed, "digest", "left_anti").select(*GROUP, "digest", F.lit(0).alias("split"), "n")
    both = pure.unionByName(numbered.select(*GROUP, "digest", "split", "n"))
    return saved(both), saved(names.join(mixed, "digest", "left_anti").unionByName(terms.select("digest", "split", "term")))


# --- shares, distances, terms ---------------------------------------------------------------------------------------


def share(n: Column, size: Column) -> Column:
    """1 + floor(10^9 * (n + SMOOTH) / size), exactly: a long division, three digits at a time."""
    rest = n + F.lit(SMOOTH)
    out = F.call_function("div", rest, size)
    for _ in range(3):
        rest = rest % size * 1000
        out = out * 1000 + F.call_function("div", rest, size)
    return out + 1


def _blocked(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("digest", "split"), blocks).cast("int")


def _distances(tile: int) -> Callable[[tuple[pa.Scalar, ...], pa.Table], pa.Table]:
    """Partial sums (lang, a, b, value), a < b, over the terms of one block, of the sources of two tiles.

    Rows are (at, digest, split, share); those without a digest stand for a source: its share of a term that it lacks, and in `terms`
    how many terms the block has.
    """

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        lang, _, low, high = (k.as_py() for k in key)
        at, terms = rows.column("at").to_numpy(), int(rows.column("terms").to_numpy().max())
        digest, split, p = rows.column("digest").combine_chunks(), rows.column("split").to_numpy(), rows.column("share").to_numpy()
        stands = np.asarray(digest.is_null())
        order = np.argsort(at[stands])
        sources, base = at[stands][order], p[stands][order]
        term = np.unique(digest.drop_null().to_numpy(), return_inverse=True)[1].astype(np.int64)
        split = split[~stands].astype(np.int64)
        term = np.unique(term * (split.max(initial=0) + 1) + split, return_inverse=True)[1]
        shares = np.repeat(base[:, None], term.max(initial=-1) + 1, axis=1)
        shares[np.searchsorted(sources, at[~stands]), term] = p[~stands]
        lacking = terms - shares.shape[1]
        second = np.flatnonzero(sources // tile == high)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(sources // tile == low):
            j = second[second > i]
            value = np.abs(shares[i] - shares[j]).sum(axis=1) + np.abs(base[i] - base[j]) * lacking
            found.append((np.full(len(j), sources[i]), sources[j], value))
        a, b, value = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        columns = [pa.array([lang] * len(a), pa.string()), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(value, pa.int64())]
        return pa.Table.from_arrays(columns, names=["lang", "a", "b", "value"])

    return run


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, bits: int = 64) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has each other source of the language by distance, part `term` the
    `top` terms whose share most exceeds the language's. `bits` is the width of a digest, small in tests only.
    """
    counts, names = vocabulary(docs, least_docs, bits)
    of_lang = saved(counts.groupBy("lang", *TERM).agg(F.sum("n").alias("lang_n")))
    langs = of_lang.groupBy("lang").agg(F.sum("lang_n").alias("lang_n"), F.count("*").alias("terms"))
    terms = F.coalesce("terms", F.lit(0))
    groups = saved(
        _rows(docs).groupBy(*GROUP).agg(F.lit(0)).select(*GROUP)
        .join(counts.groupBy(*GROUP).agg(F.sum("n").alias("n")), GROUP, "left").join(langs, "lang", "left")
        .select(
            *GROUP, terms.alias("terms"), (F.coalesce("n", F.lit(0)) + SMOOTH * terms).alias("size"), (F.coalesce("lang_n", F.lit(0)) + SMOOTH * terms).alias("lang_size"),
            F.greatest(F.lit(1), F.ceil(terms / BLOCK_TERMS)).alias("blocks"), (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("at"),
            F.floor((F.count("*").over(Window.partitionBy("lang")) + TILE - 1) / TILE).cast("int").alias("tiles"),
        )
    )
    shared = counts.join(groups, GROUP).withColumn("share", share(F.col("n"), F.col("size")))

    over = shared.join(of_lang, ["lang", *TERM]).withColumn("value", F.col("share") - share(F.col("lang_n"), F.col("lang_size"))).where("value > 0")
    by_value = Window.partitionBy(*GROUP).orderBy(F.desc("value"))
    listed = over.select(*GROUP, *TERM, "value", F.rank().over(by_value).alias("place")).where(F.col("place") <= top).drop("place")
    by_item = Window.partitionBy(*GROUP).orderBy(F.desc("value"), "item")
    named = listed.join(names, TERM).select(*GROUP, F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(by_item))

    sizes = of_lang.join(groups.select("lang", "blocks").distinct(), "lang").groupBy("lang", _blocked(F.col("blocks")).alias("block")).agg(F.count("*").alias("block_terms"))
    stands = groups.join(sizes, "lang", "left").select(
        "lang", F.coalesce("block", F.lit(0)).alias("block"), "at", "tiles", F.lit(None).cast("long").alias("digest"), F.lit(0).alias("split"),
        F.when(F.col("terms") > 0, share(F.lit(0), F.greatest("size", F.lit(1)))).otherwise(0).alias("share"), F.coalesce("block_terms", F.lit(0)).alias("terms"),
    )
    held = shared.select("lang", _blocked(F.col("blocks")).alias("block"), "at", "tiles", *TERM, "share", F.lit(0).cast("long").alias("terms"))
    tile = F.floor(F.col("at") / TILE).cast("int")
    tiled = stands.unionByName(held).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.withColumn("low", F.least(tile, "other")).withColumn("high", F.greatest(tile, "other")).drop("tiles", "other")
    sums = tiled.groupBy("lang", "block", "low", "high").applyInArrow(_distances(TILE), "lang string, a int, b int, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.select("lang", F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"), "value")
    name = groups.select("lang", "at", "source")
    pairs = both.select("lang", F.col("x.a").alias("at"), F.col("x.b").alias("other"), "value").join(name, ["lang", "at"])
    pairs = pairs.join(name.select("lang", F.col("at").alias("other"), F.col("source").alias("item")), ["lang", "other"])
    paired = pairs.select(*GROUP, F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_item).alias("rank"))
    return paired.unionByName(named.where(F.col("rank") <= top))
