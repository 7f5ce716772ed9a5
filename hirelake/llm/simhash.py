"""SimHash near-dedup with pivot distance tables.

A text's fingerprint is the bitwise majority of its word shingles' XXH64 hashes. Each different fingerprint gets
one row of the pivot table: its Hamming distances to 16 fixed reference fingerprints. Pairs within the radius are
found in three steps: (1) pigeonhole blocks give every such pair a common key; (2) below a key, rows of the pivot
table are compared, and a pair whose coordinates differ by more than the radius anywhere is discarded (triangle
inequality, so nothing is lost); (3) the distance of the survivors verifies them. Links found below a key are at
once reduced to a spanning forest, so that a large group of near copies costs as many rows as it has fingerprints
and never all its pairs. A key with very many fingerprints is dealt out by pairs of chunks.

Step (1) stands before the table because the table alone can't be searched: distances of independent 64-bit
fingerprints to any reference lie within a few bits of 32, so cells along a few coordinates hold most of the rows.

Defined results: a null text counts as empty; a text without words has fingerprint 0, one with fewer words
than a shingle is one shingle; repeated rows, and rows with a null id, are kept and share the component of
their fingerprint (the smallest non-null id in it, null if there is none); an empty table gives no rows; a text of
any length is hashed in blocks. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, arrow_rows, components, components_of, released, runs, saved, spanning_links, texts, through_disk, words

SEED = 42
PIVOTS = np.array([xxhash.xxh64_intdigest(str(i).encode(), SEED) for i in range(16)], dtype=np.uint64)
#: Coordinates compared for all pairs of a tile; the others for those that these leave.
FIRST_PIVOTS = 4
SMALL_RUN = 48
HOT_KEY = 20_000
TILE = 1 << 20


def shingle_hashes(tokens: list[bytes], k: int) -> np.ndarray:
    """XXH64 of each k-word shingle, repeats included; of the whole sequence if it is shorter."""
    if not tokens:
        return np.empty(0, np.uint64)
    line = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= k:
        return np.array([digest(line, SEED)], np.uint64)
    starts = [0, *accumulate(len(t) + 1 for t in tokens)]
    return np.array([digest(line[i : j - 1], SEED) for i, j in zip(starts, starts[k:])], np.uint64)


def fingerprint(tokens: list[bytes], k: int) -> int:
    """Signed 64-bit SimHash; a bit is 1 if it is set in over half of the shingle hashes."""
    h = shingle_hashes(tokens, k)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 15):
        part = h[i : i + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4) -> DataFrame:
    """(id, fp): the signed 64-bit fingerprint of each row's whole text."""
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(words(t), k) for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(fp, pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(lambda b: released(run(b)), "id long, fp long")


def block_masks(radius: int, spare: int = 3, bits: int = 64) -> list[int]:
    """Masks such that two fingerprints within the radius agree below at least one of them.

    The bits are cut into radius + spare blocks; at least `spare` of them hold no differing bit.
    """
    n = radius + spare
    edges = [round(i * bits / n) for i in range(n + 1)]
    blocks = [((1 << (e - s)) - 1) << s for s, e in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, spare)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def pivot_table(fps: DataFrame) -> DataFrame:
    """fps (fp, ...) with columns pivots_0, pivots_1: distances to the references, a byte each, eight to a long."""

    def packed(pivots: np.ndarray) -> Column:
        parts = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(int(p))))).cast("long"), 8 * i) for i, p in enumerate(pivots)]
        return reduce(Column.__add__, parts)

    return fps.withColumns({f"pivots_{k}": packed(PIVOTS[8 * k : 8 * k + 8]) for k in range(len(PIVOTS) // 8)})


def pivots_keep(one: np.ndarray, two: np.ndarray, radius: int) -> np.ndarray:
    """Whether rows of the pivot table (n, 16) differ by the radius at most in every coordinate."""
    return (np.abs(one - two) <= radius).all(axis=1)


def _verified(f: np.ndarray, table: np.ndarray, x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of places (x, y): those that the pivot table keeps and the distance confirms."""
    keep = pivots_keep(table[x], table[y], radius)
    x, y = x[keep], y[keep]
    keep = np.bitwise_count(f[x] ^ f[y]) <= radius
    return x[keep], y[keep]


def _large_run(f: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one key's many fingerprints, in tiles cut along the first pivot's distance."""
    order = np.argsort(table[:, 0], kind="stable")
    f, table = f[order], table[order]
    columns = np.ascontiguousarray(table.T)
    a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    step = max(1, TILE // len(f))
    for i in range(0, len(f), step):
        j = min(len(f), i + step)
        end = int(np.searchsorted(columns[0], columns[0, j - 1] + radius, side="right"))
        near = np.ones((j - i, end - i), bool)
        for c in columns[:FIRST_PIVOTS]:
            near &= np.abs(c[i:j, None] - c[None, i:end]) <= radius
        x, y = np.nonzero(near)
        ahead = x < y
        x, y = _verified(f[i:end], table[i:end], x[ahead], y[ahead], radius)
        s, t = spanning_links(f[i:end][x], f[i:end][y])
        a.append(s)
        b.append(t)
    return spanning_links(np.concatenate(a), np.concatenate(b))


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for t in runs(batches, "key"):
        key, f = t.column("key").to_numpy(), t.column("fp").to_numpy().view(np.uint64)
        table = np.stack([t.column(f"pivots_{k}").to_numpy() for k in range(len(PIVOTS) // 8)], axis=1).view(np.int8)
        a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        for i, n in zip(first[size > SMALL_RUN], size[size > SMALL_RUN]):
            s, u = _large_run(f[i : i + n], table[i : i + n], radius)
            a.append(s)
            b.append(u)
        small = np.repeat(size <= SMALL_RUN, size)
        key, f, table = key[small], f[small], table[small]
        for lag in range(1, int(min(SMALL_RUN, size.max()))):
            same = np.flatnonzero(key[lag:] == key[:-lag])
            if not len(same):
                break
            x, y = _verified(f, table, same, same + lag, radius)
            a.append(f[x])
            b.append(f[y])
        x, y = spanning_links(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], names=["a", "b"])


def dealt(keyed: DataFrame, value: str, cap: int | None = None, some: DataFrame | None = None, share: int = 1) -> DataFrame:
    """keyed, partitioned and sorted by key; a key of more than `cap` rows is cut into chunks by its values' hash.

    Each of its rows goes to every pair of chunks with its own, under a key of that pair, so that no pair of rows is lost
    and no task gets more than two chunks of a key. With `some`, keyed rows of one value in `share`, a key's rows are estimated from these.
    """
    cap = cap or HOT_KEY
    counted = keyed if some is None else some
    hot = through_disk(counted.groupBy("key").agg((F.count("*") * share).alias("n")).where(F.col("n") > cap).select("key", F.ceil(F.col("n") / cap).cast("int").alias("chunks")), "hot-keys")
    own = F.pmod(F.xxhash64(value), F.col("chunks")).cast("int")
    marked = keyed.join(hot, "key", "left").withColumns({"own": own, "other": F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))})
    key = F.when(F.col("chunks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    return marked.withColumn("key", key).select(keyed.columns).repartition("key").sortWithinPartitions("key")


def fingerprint_links(table: DataFrame, radius: int = 4, spare: int = 3) -> DataFrame:
    """Links (a, b) that join all fingerprints of a pivot table within the radius, as spanning forests per key."""
    masks = [_signed(m) for m in block_masks(radius, spare)]
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)])
    keyed = table.select(F.explode(keys).alias("key"), "fp", "pivots_0", "pivots_1")
    return dealt(keyed, "fp").mapInArrow(lambda it: released(_links(it, radius)), "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, radius: int = 4) -> DataFrame:
    """One row per input row: (doc_id, fp, component_id), linking fingerprints at `radius` or fewer differing bits."""
    rows = through_disk(fingerprints(docs, id_col, text_col, k), "fingerprints")
    classes = saved(pivot_table(rows.groupBy("fp").agg(F.min("id").alias("least"))))
    joined = components(fingerprint_links(classes, radius))
    named = saved(classes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    # a table of its own, so that a component with very many rows is joined by broadcast, or split as a skewed key
    least = through_disk(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    of_fp = named.join(least, "component").select("fp", "component_id")
    return rows.join(of_fp, "fp").select(F.col("id").alias("doc_id"), "fp", "component_id")


def hex_fingerprint(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


# --- near copies by similarity -------------------------------------------------------------------------------------
# The similarity is the cosine of two texts' sets of shingles, which is what SimHash estimates: at 0.8, fingerprints
# differ in 20 % of their bits. That is too wide for blocks that guarantee all pairs, and for pivots to discard any, so
# wider fingerprints are banded: pairs that agree on some band are candidates. 256 bits, and 48 bands of 14, find 86 %
# of the pairs at a cosine of 0.8, 97 % at 0.86 (Jaccard 0.75) and 99.6 % at 0.9.

WIDE_WORDS = 4
BANDS = 48
BAND_BITS = 14
SURE, MAYBE = 26, 70  # bits: linked as they are; verified by their shingles
HOT_BAND = 2048
#: Of so many fingerprints one is counted to find the large keys.
COUNTED = 8
BAND_ROWS = 8192
#: Pairs that a key may list for each of its rows; a key with more lists a spanning forest, and its rows.
LISTED = 2
PAIR_TILE = 1 << 18
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
#: References of the wide pivot table; a distance is a byte, so 256 counts as 255, which brings no two rows further apart.
WIDE_PIVOTS = np.array([[xxhash.xxh64_intdigest(f"{i}.{j}".encode(), SEED) for j in range(WIDE_WORDS)] for i in range(8)], dtype=np.uint64)
_POSITIONS = np.concatenate([np.random.default_rng(i).permutation(64 * WIDE_WORDS) for i in range(-(-BANDS * BAND_BITS // (64 * WIDE_WORDS)))])[: BANDS * BAND_BITS].reshape(BANDS, BAND_BITS)


def wide_fingerprint(tokens: list[bytes], k: int) -> np.ndarray:
    """256-bit SimHash of the different shingles, as 4 words; zeros without words."""
    h = np.unique(shingle_hashes(tokens, k))
    ones = np.zeros(64 * WIDE_WORDS, np.int64)
    for i in range(0, len(h), 1 << 12):
        part = h[i : i + (1 << 12)]
        more = [part]
        for m in _MIX:
            x = (part ^ (part >> np.uint64(31))) * m
            more.append(x ^ (x >> np.uint64(29)))
        wide = np.stack(more, axis=1)
        ones += np.unpackbits(wide.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)


def wide_pivot_rows(f: np.ndarray) -> np.ndarray:
    """The pivot table's rows (n, 8) of fingerprints (n, words)."""
    apart = [np.bitwise_count(f ^ p).sum(axis=1, dtype=np.int64) for p in WIDE_PIVOTS]
    return np.minimum(np.stack(apart, axis=1), 255).astype(np.uint8)


def _with_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (fp, node) with their row of the pivot table after the fingerprint's bytes."""
    for b in batches:
        f = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint64).reshape(b.num_rows, WIDE_WORDS)
        rows = np.hstack([f.view(np.uint8).reshape(b.num_rows, 8 * WIDE_WORDS), wide_pivot_rows(f)])
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), b.column("node")], names=["fp", "node"])


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (n, words), and their rows of the pivot table (n, 8)."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 8 * WIDE_WORDS + len(WIDE_PIVOTS))
    return np.ascontiguousarray(raw[:, : 8 * WIDE_WORDS]).view(np.uint64), raw[:, 8 * WIDE_WORDS :].astype(np.int16)


def _wide(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows (row, further columns, text) with the text's fingerprint in its place."""
    for b in batches:
        fp = [wide_fingerprint(words(t), k).tobytes() for t in texts(b.column("text"))]
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp, pa.binary())], names=[*b.schema.names[:-1], "fp"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = (1 << np.arange(BAND_BITS)).astype(np.int64)
    for b in batches:
        if not b.num_rows:
            continue
        fp = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(b.num_rows, -1)
        bits = np.unpackbits(fp[:, : 8 * WIDE_WORDS], axis=1, bitorder="little")
        keys = (bits[:, _POSITIONS] @ weights) + (np.arange(BANDS, dtype=np.int64) << BAND_BITS)[None, :]
        at = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *[b.column(c).take(at) for c in ("node", "fp")]], names=["key", "node", "fp"])


def _apart(f: np.ndarray, x: slice | np.ndarray, y: slice | np.ndarray) -> np.ndarray:
    """Bits in which fingerprints (n, words) at x differ from those at y: pair by pair, or of slices all with all."""
    d: np.ndarray | int = 0
    for w in f.T:
        d = d + np.bitwise_count(w[x, None] ^ w[None, y] if isinstance(x, slice) else w[x] ^ w[y]).astype(np.int16)
    return d


def _forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of the links of a minimum spanning forest, by rounds of each component's lightest link."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label, left, chosen = np.arange(len(nodes)), np.arange(len(a)), [np.empty(0, np.int64)]
    place = np.argsort(weight, kind="stable")
    order = np.empty(len(a), np.int64)
    order[place] = np.arange(len(a))  # all different, so rounds make no ring
    while True:
        left = left[label[x[left]] != label[y[left]]]
        if not len(left):
            return np.concatenate(chosen)
        lightest = np.full(len(nodes), len(a), np.int64)
        np.minimum.at(lightest, label[x[left]], order[left])
        np.minimum.at(lightest, label[y[left]], order[left])
        new = place[np.unique(lightest[lightest < len(a)])]
        chosen.append(new)
        ends, least = components_of(label[x[new]], label[y[new]])
        moved = np.arange(len(nodes))
        moved[ends] = least
        label = moved[label]


def _undecided(label: np.ndarray, x: np.ndarray, y: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of places less those that sure ones among them have put together; of sure ones a forest is left."""
    sure = d <= SURE
    if not sure.any():
        return x, y, d
    nodes, least = components_of(label[x[sure]], label[y[sure]])

    def group(at: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(nodes, label[at]), len(nodes) - 1)
        return np.where(nodes[place] == label[at], least[place], label[at])

    keep = np.flatnonzero(~sure)
    keep = keep[group(x[keep]) != group(y[keep])]
    at = np.flatnonzero(sure)
    keep = np.concatenate([at[_forest(label[x[at]], label[y[at]], d[at])], keep])
    return x[keep], y[keep], d[keep]


def _near_pairs(f: np.ndarray, pivots: np.ndarray, label: np.ndarray, most: int, similarity: float = 0.0, size: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """Places and bits of the pairs within MAYBE bits and of different labels, and whether these are all.

    Pairs whose rows of the pivot table differ by more than MAYBE anywhere are discarded before their distances are taken. Pairs that sure ones have put together are left out, and those whose sets differ too much in `size`. More than `most` are cut down to a minimum spanning forest of the
    labels, tile by tile, so that memory stays bounded.
    """
    n, whole = len(f), True
    x, y, d = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int16)
    step = max(1, PAIR_TILE // n)
    for s in range(0, n, step):
        e = min(n, s + step)
        near = label[s:e, None] != label[None, s:]
        for c in pivots.T:
            near &= np.abs(c[s:e, None] - c[None, s:]) <= MAYBE
        if size is not None:  # the cosine of two sets is at most the root of their sizes' ratio
            near &= np.minimum(size[s:e, None], size[None, s:]) >= similarity * similarity * np.maximum(size[s:e, None], size[None, s:]) - 1e-9
        p, q = np.nonzero(near)
        ahead = p < q
        p, q = p[ahead] + s, q[ahead] + s
        apart = _apart(f, p, q)
        keep = apart <= MAYBE
        x, y, d = np.concatenate([x, p[keep].astype(np.int32)]), np.concatenate([y, q[keep].astype(np.int32)]), np.concatenate([d, apart[keep]])
        if len(x) > most:
            x, y, d = _undecided(label, x, y, d)
        if len(x) > most + n:
            keep, whole = _forest(label[x], label[y], d), False
            x, y, d = x[keep], y[keep], d[keep]
    return x, y, d, whole


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b, bits) of each key's rows, bits 0 for sure ones; of a key that didn't list all its pairs, its rows (key, a, fp)."""
    for t in runs(batches, "key"):
        key, node = (t.column(c).to_numpy() for c in ("key", "node"))
        label, (f, pivots) = node, _unpacked(t.column("fp"))
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[first, len(key)])
        run = np.repeat(np.arange(len(size)), size)
        x, y, d, again = [first[:0]], [first[:0]], [np.empty(0, np.int16)], np.zeros(len(size), bool)
        for r in np.flatnonzero(size > SMALL_RUN).tolist():
            i, n = first[r], size[r]
            p, q, bits, whole = _near_pairs(f[i : i + n], pivots[i : i + n], label[i : i + n], int(LISTED * n))
            x.append(p + i)
            y.append(q + i)
            d.append(bits)
            again[r] = not whole
        small = np.repeat(size <= SMALL_RUN, size)
        for lag in range(1, int(min(SMALL_RUN, size.max()))):
            same = np.flatnonzero((run[lag:] == run[:-lag]) & small[lag:] & (label[lag:] != label[:-lag]))
            same = same[pivots_keep(pivots[same], pivots[same + lag], MAYBE)]
            bits = _apart(f, same, same + lag)
            near = bits <= MAYBE
            x.append(same[near])
            y.append(same[near] + lag)
            d.append(bits[near])
        x, y, d = _undecided(label, np.concatenate(x), np.concatenate(y), np.concatenate(d))
        many = (np.bincount(run[x], minlength=len(size)) > LISTED * size) & (size <= SMALL_RUN)
        if many.any():
            over = np.flatnonzero(many[run[x]])
            _, name = np.unique(np.stack([run, label]), axis=1, return_inverse=True)
            keep = np.sort(np.concatenate([np.flatnonzero(~many[run[x]]), over[_forest(name[x[over]], name[y[over]], d[over])]]))
            x, y, d, again = x[keep], y[keep], d[keep], again | many
        again = again[run]
        bits = np.where(d <= SURE, 0, d)
        at = pa.array(np.flatnonzero(again))
        none, held = pa.nulls(len(x), pa.int64()), pa.nulls(len(at), pa.int64())
        columns = [
            pa.concat_arrays([none, pa.array(key[again])]),
            pa.concat_arrays([pa.array(node[x]), pa.array(node[again])]),
            pa.concat_arrays([pa.array(node[y]), held]),
            pa.concat_arrays([pa.array(bits, pa.int32()), held.cast(pa.int32())]),
            pa.concat_arrays([pa.nulls(len(x), pa.binary()), *t.column("fp").take(at).cast(pa.binary()).chunks]),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["key", "a", "b", "bits", "fp"])


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """Of two sets of shingle hashes, each without repeats; 0 if one is empty."""
    return len(np.intersect1d(x, y, assume_unique=True)) / max(1.0, float(len(x)) * len(y)) ** 0.5


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        held = [np.unique(shingle_hashes(words(t), k)).tobytes() for t in texts(b.column("text"))]
        yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(held, pa.binary())], names=["row", "shingles"])


def _passed(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in (batch.slice(i, 64) for i in range(0, batch.num_rows, 64)):
            pairs = zip(b.column("left").to_pylist(), b.column("right").to_pylist())
            ok = [cosine(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)) >= similarity - 1e-12 for s, t in pairs]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], names=["a", "b", "ok"])


def _labelled(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with their ends' components x < y; those within one component are left out."""
    of = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"g_{c}"))
    x, y = F.coalesce("g_a", "a"), F.coalesce("g_b", "b")
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumns({"x": F.least(x, y), "y": F.greatest(x, y)}).where("x < y").drop("g_a", "g_b")


def _sets_of(rows: DataFrame, nodes: DataFrame, k: int, repeated: bool) -> DataFrame:
    """(row, shingles) of the nodes (row), once each, a table of its own, so that its size decides how it is joined."""
    found = rows.join(nodes, "row").select("row", "text").mapInArrow(lambda it: released(_sets(it, k)), "row long, shingles binary")
    return through_disk(found.dropDuplicates(["row"]) if repeated else found, "shingles")


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """Components (node, component) with further links between their nodes."""
    stars = groups.select(F.col("node").alias("a"), F.col("component").alias("b")).where("a <> b")
    return saved(components(stars.unionByName(links.select("a", "b"))))


def _decided(rows: DataFrame, pairs: DataFrame, links: DataFrame, k: int, similarity: float, repeated: bool) -> DataFrame:
    """links, and those of the unsure pairs (a, b, bits) that hold, as components (node, component).

    First every component's nearest pair to another one is verified, and then all that are still between two components.
    """
    groups = saved(components(links))
    found = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "bits").distinct()
    left = through_disk(_labelled(found, groups).select("a", "b", "bits"), "unsure")
    ends = through_disk(left.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "ends")
    some = _sets_of(rows, ends, k, repeated)
    one, two = some.select(F.col("row").alias("a"), F.col("shingles").alias("left")), some.select(F.col("row").alias("b"), F.col("shingles").alias("right"))
    for nearest in (True, False):
        now = saved(_labelled(left, groups))
        if now.isEmpty():
            break
        if nearest:
            sides = now.select(F.explode(F.array("x", "y")).alias("side"), "a", "b", "bits")
            now = sides.groupBy("side").agg(F.min_by(F.struct("a", "b"), F.struct("bits", "a", "b")).alias("p")).select("p.a", "p.b").distinct()
        checked = through_disk(now.select("a", "b").join(one, "a").join(two, "b").mapInArrow(lambda it: _passed(it, similarity), "a long, b long, ok boolean"), "checked")
        groups = _joined(groups, checked.where("ok"))
        left = left.join(checked.select("a", "b"), ["a", "b"], "left_anti")
    return groups


def _tested(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of each key's rows: pairs within MAYBE bits, nearest first, tested unless links have put their labels together."""
    for t in runs(batches, "key"):
        key, node, label = (t.column(c).to_numpy() for c in ("key", "node", "label"))
        f, pivots = _unpacked(t.column("fp"))
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        size = np.array([len(x) for x in sets], np.float64)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        out_a, out_b = [], []
        for i, n in zip(first.tolist(), np.diff(np.r_[first, len(key)]).tolist()):
            parent = {x: x for x in label[i : i + n].tolist()}

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            x, y, d, _ = _near_pairs(f[i : i + n], pivots[i : i + n], label[i : i + n], n * n, similarity, size[i : i + n])
            order = np.argsort(d, kind="stable")
            for p, q in zip((x[order] + i).tolist(), (y[order] + i).tolist()):
                one, two = root(int(label[p])), root(int(label[q]))
                if one != two and cosine(sets[p], sets[q]) >= similarity - 1e-12:
                    parent[one] = two
                    out_a.append(int(node[p]))
                    out_b.append(int(node[q]))
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])


def similar_rows(rows: DataFrame, k: int = 5, similarity: float = 0.8) -> DataFrame:
    """Each of rows (row, text, ..) with its component in place of its text: groups of texts with similar sets of word shingles.

    Rows of one number (row, a long) have one text; rows are read several times, so they should come from a table.
    Equal fingerprints, and those that differ in SURE bits at most, are linked; pairs of up to MAYBE bits are linked if their
    shingles' cosine is as given. Every such pair of a band is decided, unless links have put its ends together. A key with few
    pairs lists them. One with many lists a spanning forest, for the links that are found soonest; what that leaves apart is
    tested where the key's rows lie, with their shingles beside them, so that of a large group only links are given out.
    """
    arrow_batches(rows.sparkSession)
    others = [c for c in rows.columns if c not in ("row", "text")]
    kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in others)
    prints = through_disk(rows.select("row", *others, "text").mapInArrow(lambda it: released(_wide(it, k)), f"row long, {kinds}fp binary"), "wide")
    rows = rows.select("row", "text")
    repeated = not prints.groupBy("row").count().where("count > 1").isEmpty()
    nodes = saved(prints.groupBy("fp").agg(F.min("row").alias("node")))
    table = nodes.mapInArrow(_with_pivots, "fp binary, node long")
    # an eighth of the fingerprints tells the large keys, whose chunks need no exact size: most keys hold few rows, which no count combines
    some = table.where(F.pmod(F.xxhash64("node"), F.lit(COUNTED)) == 0).mapInArrow(_bands, "key long, node long, fp binary")
    keyed = dealt(table.mapInArrow(_bands, "key long, node long, fp binary"), "node", HOT_BAND, some, COUNTED)
    with arrow_rows(rows.sparkSession, BAND_ROWS):
        found = through_disk(keyed.mapInArrow(lambda it: released(_candidates(it)), "key long, a long, b long, bits int, fp binary"), "candidates")
    groups = _decided(rows, found.where("bits > 0").select("a", "b", "bits"), found.where("bits = 0").select("a", "b"), k, similarity, repeated)
    again = found.where("key IS NOT NULL").select("key", F.col("a").alias("node"), "fp").join(groups, "node", "left").select("key", "node", F.coalesce("component", "node").alias("label"), "fp")
    apart = again.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    again = through_disk(again.join(through_disk(apart, "apart"), "key", "left_semi"), "again")
    if not again.isEmpty():
        some = _sets_of(rows, again.select(F.col("node").alias("row")).distinct(), k, repeated).withColumnRenamed("row", "node")
        held = again.join(some, "node").select("key", "node", "label", "fp", "shingles").repartition("key").sortWithinPartitions("key")
        groups = _joined(groups, through_disk(held.mapInArrow(lambda it: released(_tested(it, similarity)), "a long, b long"), "tested"))
    classes = nodes.join(groups, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    return prints.join(classes, "fp").select("row", *others, "component")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of similar texts: that with the smallest id (nulls last), of equal ids one.

    A null text counts as empty; texts without words form one group; repeated rows are copies; an empty table stays empty;
    all columns are kept. Rows are told apart by the 64-bit hash of id and text, so that no text is written; docs is read
    several times, so it should be a table.
    """
    text = F.col(text_col).cast("string")
    rows = docs.select(F.xxhash64(F.col(id_col).isNull(), F.col(id_col), text).alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    placed = saved(similar_rows(rows, k, similarity))
    first = placed.groupBy("component").agg(F.min_by("row", F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))).alias("_row"))
    first = through_disk(first.select("_row"), "first")
    of_first = placed.select(F.col("row").alias("_row"))
    # the rows that go are a table of their own: if it is small it is broadcast and no text moves
    copies = through_disk(of_first.join(first, "_row", "left_anti").distinct(), "copies")
    again = through_disk(of_first.join(first, "_row", "left_semi").groupBy("_row").count().where("count > 1").select("_row"), "repeated")
    kept = docs.withColumn("_row", F.xxhash64(F.col(id_col).isNull(), F.col(id_col), text)).join(copies, "_row", "left_anti")
    if not again.isEmpty():
        kept = kept.join(again, "_row", "left_anti").unionByName(kept.join(again, "_row", "left_semi").dropDuplicates(["_row"]))
    return kept.drop("_row")
