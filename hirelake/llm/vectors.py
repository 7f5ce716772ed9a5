"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors x, y have cosine >= t exactly if |x - y|^2 <= 2 - 2t. After a fixed random rotation the
coordinates are cut into low-dimensional blocks; in at least one block the squared distance is within the
block's share of that budget (in proportion to its dimensions). Each block is a range join: vectors are
dealt to slabs along the block's first coordinate, each also to those slabs to its right that lie within
the block's radius, and a slab's pairs are tested on the block alone. A pair counts in the first block whose
budget it meets, so the union over blocks holds each pair once, and is verified by its cosine in double
precision on the vectors as given. A slab of very many rows, own and reaching in, is cut into chunks and dealt out
by pairs of chunks, so that a task's memory doesn't grow with the table. Slabs return link counts per vector and a spanning forest, not the pairs.

Equal vectors are one class before the join; a class weighs as many vectors as it has rows.

Cost: in 8 dimensions the radius of a block is close to the spread of a coordinate, so slabs prune little
and the tests grow with the square of the number of different vectors, as for any exact method at this
radius; each test costs 8 multiplications.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component links with
nothing; vectors of different lengths don't link; repeated rows count one by one; a row with a null id counts
as a vector but is never the smallest id; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, saved, spanning_links, through_disk

BLOCK_DIMS = 8
SLAB_ROWS = 16384
#: Components of a chunk's vectors; a slab of more than two chunks is cut.
CHUNK_CELLS = 1 << 21
SAMPLE_ROWS = 20000
TILE = 1 << 23
VERIFY = 1 << 17


def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(64 + dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int) -> list[slice]:
    n = max(1, round(dim / BLOCK_DIMS))
    edges = [round(i * dim / n) for i in range(n + 1)]
    return [slice(s, e) for s, e in zip(edges, edges[1:])]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _deal(batches: Iterator[pa.RecordBatch], cuts: dict[int, np.ndarray], budget: float) -> Iterator[pa.RecordBatch]:
    """Each vector once for each slab of each block that it belongs to or reaches from the left."""
    for b in batches:
        dims = b.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            rows = b.filter(pa.array(dims == dim))
            turned = _unit(_matrix(rows.column("vec"), dim)) @ rotation(dim)
            take, block, slab, home = [], [], [], []
            for k, s in enumerate(blocks_of(dim)):
                u = turned[:, s.start]
                reach = np.sqrt(budget * (s.stop - s.start) / dim) * (1 + 1e-9) + 1e-9
                first = np.searchsorted(cuts[dim][k], u, side="right")
                last = np.searchsorted(cuts[dim][k], u + reach, side="right")
                n = last - first + 1
                at = np.repeat(np.arange(len(u)), n)
                step = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                take.append(at)
                block.append(np.full(len(at), k))
                slab.append(first[at] + step)
                home.append(step == 0)
            take = np.concatenate(take)
            out = rows.take(pa.array(take))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(block), pa.int32()), pa.array(np.concatenate(slab), pa.int32()), pa.array(np.concatenate(home)), out.column("node"), out.column("n"), out.column("dim"), out.column("vec")],
                names=["block", "slab", "home", "node", "n", "dim", "vec"],
            )


def _cells(batches: Iterator[pa.RecordBatch], cuts: dict[int, np.ndarray], budget: float) -> Iterator[pa.RecordBatch]:
    for b in _deal(batches, cuts, budget):
        yield b.select(["dim", "block", "slab", "home"])


def _grouped(classes: DataFrame, cuts: dict[int, np.ndarray], budget: float) -> DataFrame:
    """The dealt vectors by (dim, block, slab, one, two): all of a slab, or two of its chunks, of which side tells one from two.

    Slabs are cut by their vectors' hash. Chunks from 0 are of the slab's own rows, those below 0 of rows that reach in; a
    pair of chunks has one chunk of own rows at least, and each such pair is one group.
    """
    kind = dict(classes.dtypes)["vec"]
    rows = classes.select("node", "n", "dim", "vec")
    cells = rows.mapInArrow(lambda it: _cells(it, cuts, budget), "dim int, block int, slab int, home boolean").groupBy("dim", "block", "slab").agg(F.count_if("home").alias("own"), F.count("*").alias("all"))
    cap = F.greatest(F.lit(1), F.floor(F.lit(CHUNK_CELLS) / F.col("dim")))
    chunks = lambda n: F.ceil(n / cap).cast("int")
    hot = through_disk(cells.where(F.col("all") > 2 * cap).select("dim", "block", "slab", F.greatest(F.lit(1), chunks(F.col("own"))).alias("h"), chunks(F.col("all") - F.col("own")).alias("r")), "hot-slabs")
    dealt = rows.mapInArrow(lambda it: _deal(it, cuts, budget), f"block int, slab int, home boolean, node long, n long, dim int, vec {kind}")
    at = F.when(F.col("home"), F.pmod(F.xxhash64("node"), F.col("h"))).otherwise(-1 - F.pmod(F.xxhash64("node"), F.col("r"))).cast("int")
    group = lambda one, two, side: F.struct(one.cast("int").alias("one"), two.cast("int").alias("two"), side.cast("int").alias("side"))
    own = F.sequence(F.lit(0), F.col("h") - 1)
    none = F.array().cast("array<struct<one:int,two:int,side:int>>")
    among = F.transform(own, lambda j: group(F.least("at", j), F.greatest("at", j), F.col("at") > j))
    reached = F.when(F.col("r") > 0, F.transform(F.sequence(F.lit(1), F.col("r")), lambda j: group(F.col("at"), -j, F.lit(0)))).otherwise(none)
    reaching = F.transform(own, lambda j: group(j, F.col("at"), F.lit(1)))
    groups = F.when(F.col("h").isNull(), F.array(group(F.lit(0), F.lit(0), F.lit(0)))).when(F.col("home"), F.concat(among, reached)).otherwise(reaching)
    return dealt.join(hot, ["dim", "block", "slab"], "left").withColumn("at", at).withColumn("to", F.explode(groups)).select("dim", "block", "slab", "to.one", "to.two", "to.side", "home", "node", "n", "vec")


def _first_block(x: np.ndarray, y: np.ndarray, block: int, parts: list[slice], budget: float) -> np.ndarray:
    """Whether `block` is the first of which x and y meet the budget."""
    keep = np.ones(len(x), bool)
    for k, s in enumerate(parts[: block + 1]):
        at = np.flatnonzero(keep)
        d = x[at, s] - y[at, s]
        met = (d * d).sum(axis=1) <= budget * (s.stop - s.start) / x.shape[1] + 1e-12
        keep[at] = met if k == block else ~met
    return keep


def _slab(group: pa.Table, threshold: float) -> pa.Table:
    dim, block = group.column("dim")[0].as_py(), group.column("block")[0].as_py()
    parts, budget = blocks_of(dim), 2 - 2 * threshold
    s = parts[block]
    node, n = group.column("node").to_numpy(), group.column("n").to_numpy()
    home = group.column("home").to_numpy(zero_copy_only=False)
    side, whole = group.column("side").to_numpy(), group.column("one")[0] == group.column("two")[0]
    x = _unit(_matrix(group.column("vec"), dim))
    turned = x @ rotation(dim)
    order = np.argsort(turned[:, s.start], kind="stable")
    node, n, home, side, x, turned = node[order], n[order], home[order], side[order], x[order], turned[order]
    u, low = turned[:, s.start], turned[:, s].astype(np.float32)
    half = (low * low).sum(axis=1, keepdims=True) / 2
    left, right = np.hstack([low, half, np.ones_like(half)]), np.hstack([low, -np.ones_like(half), -half])
    share = budget * (s.stop - s.start) / dim
    reach, floor = np.sqrt(share) * (1 + 1e-9) + 1e-9, np.float32(-share / 2 - 2e-6)
    count = np.zeros(len(node), np.int64)
    links_a, links_b = [node[:0]], [node[:0]]
    step = max(1, TILE // max(1, len(node)))
    for i in range(0, len(node), step):
        j = min(len(node), i + step)
        if not home[i:j].any():
            continue
        begin = int(np.searchsorted(u, u[i] - reach))
        flat = np.flatnonzero((left[i:j] @ right[begin:j].T) >= floor)
        q, p = flat // (j - begin) + i, flat % (j - begin) + begin
        keep = (p < q) & home[q] & (whole | (side[q] != side[p]))
        q, p = q[keep], p[keep]
        found_q, found_p = [q[:0]], [p[:0]]
        for c in range(0, len(q), VERIFY):
            a, b = q[c : c + VERIFY], p[c : c + VERIFY]
            keep = _first_block(turned[a], turned[b], block, parts, budget)
            a, b = a[keep], b[keep]
            keep = (x[a] * x[b]).sum(axis=1) >= threshold
            found_q.append(a[keep])
            found_p.append(b[keep])
        q, p = np.concatenate(found_q), np.concatenate(found_p)
        count += np.bincount(q, n[p], len(node)).astype(np.int64) + np.bincount(p, n[q], len(node)).astype(np.int64)
        a, b = spanning_links(node[q], node[p])
        links_a.append(a)
        links_b.append(b)
    a, b = spanning_links(np.concatenate(links_a), np.concatenate(links_b))
    some = count > 0
    return pa.table(
        {
            "a": pa.array(np.concatenate([node[some], a]), pa.int64()),
            "b": pa.array(np.concatenate([np.zeros(int(some.sum()), np.int64), b]), pa.int64(), mask=np.arange(int(some.sum()) + len(b)) < int(some.sum())),
            "links": pa.array(np.concatenate([count[some], np.zeros(len(b), np.int64)]), pa.int64()),
        }
    )


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row; links are pairs of cosine >= threshold."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    valid = F.coalesce(F.col("vec").isNotNull() & finite & F.exists("vec", lambda v: v != 0), F.lit(False))
    good = rows.where(valid)
    classes = through_disk(
        good.groupBy("vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("n")).select(F.monotonically_increasing_id().alias("node"), "vec", F.size("vec").alias("dim"), "least", "n"),
        "vectors",
    )
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}
    total = sum(sizes.values())
    cuts: dict[int, np.ndarray] = {}
    if total:
        sample = classes.sample(min(1.0, SAMPLE_ROWS / total), seed=7).select("dim", "vec").toPandas()
        for dim, size in sizes.items():
            seen = [v for d, v in zip(sample["dim"], sample["vec"]) if d == dim]
            turned = _unit(np.array(seen, np.float64)) @ rotation(dim) if seen else np.zeros((1, dim))
            at = np.linspace(0, 1, -(-size // SLAB_ROWS) + 1)[1:-1]
            cuts[dim] = np.array([np.quantile(turned[:, s.start], at) for s in blocks_of(dim)])
    budget = 2 - 2 * threshold
    dealt = _grouped(classes, cuts, budget)
    found = through_disk(dealt.groupBy("dim", "block", "slab", "one", "two").applyInArrow(lambda t: _slab(t, threshold), "a long, b long, links long"), "links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = components(found.where("b IS NOT NULL").select("a", "b"))
    named = saved(classes.join(joined, "node", "left").join(counts, "node", "left").select("vec", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_vec = named.join(least, "component").select("vec", "n_links", "component_id")
    linked = good.join(of_vec, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where(~valid).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
