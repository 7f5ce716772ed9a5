"""Embeddings: texts, metadata, validation, nearest neighbours, and knowledge look-up."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import settled

QUERY_BLOCK_BYTES = 16_000_000
#: Scores that a task holds at once, and queries that it takes at a time.
SCORE_CELLS = 1 << 20
QUERIES_AT_ONCE = 1 << 12
#: Words of definitions that go to the tasks at once (some 30 MB).
WORDS_AT_ONCE = 1 << 18


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the vectors of that width, and these as rows of doubles; no vector becomes an object of its own, so that memory is the numbers'."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), width), False).to_numpy(zero_copy_only=False))
    return at, column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), width)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _best(score: np.ndarray, name: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores of each row with their names; of equals the lower name."""
    order = np.lexsort((name, -score), axis=1)[:, :k]
    return np.take_along_axis(score, order, 1), np.take_along_axis(name, order, 1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for a zero or mismatched vector."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def valid(v: Column, dims: tuple[int, ...]) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.size(v).isin(*dims) & finite, F.lit(False))


def route_vectors(df: DataFrame, dims: tuple[int, ...]) -> DataFrame:
    """df (language, vector, multilingual) with route and routed: Arabic rows take their multilingual vector if it is valid."""
    many = (F.col("language") == "ar") & valid(F.col("multilingual"), dims)
    return df.withColumns({"route": F.when(many, "multilingual").otherwise("standard"), "routed": F.when(many, F.col("multilingual")).otherwise(F.col("vector"))})


def semantic_scores(pairs: DataFrame) -> DataFrame:
    """(job_id, candidate_id, semantic_score) of pairs with vectors a and b: their cosine, between 0 and 1."""
    return pairs.select("job_id", "candidate_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), cosine(F.col("a"), F.col("b")))).alias("semantic_score"))


BLOCK_ROWS, BLOCKS_AT_ONCE = 256, 16


def _in_blocks(rows: DataFrame, key: str, label: str, kept: str, vector: str) -> DataFrame:
    """(label, block, ids, vectors): a label's rows in blocks of about BLOCK_ROWS."""
    sizes = rows.groupBy(label).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    each = rows.join(sizes, label).withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    of = F.collect_list(F.struct(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")))
    return each.groupBy(label, "block").agg(of.alias(kept))


def _cosines(a: list, b: list) -> np.ndarray:
    """Cosines of all with all, between 0 and 1; 0 for zero, null or mismatched vectors and those with components that are no numbers."""

    def unit(vectors: list, width: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.array([i for i, v in enumerate(vectors) if v is not None and len(v) == width and None not in v], np.int64)
        x = np.array([vectors[i] for i in at], np.float64).reshape(len(at), width)
        size = np.sqrt((x * x).sum(axis=1))
        good = np.isfinite(size) & (size > 0)
        return at[good], x[good] / size[good, None]

    out = np.zeros((len(a), len(b)))
    for width in {len(v) for v in a if v} & {len(v) for v in b if v}:
        (i, x), (j, y) = unit(a, width), unit(b, width)
        out[np.ix_(i, j)] = np.clip(x @ y.T, 0.0, 1.0)
    return out


def semantic_scores_by(jobs: DataFrame, cands: DataFrame, label: str) -> DataFrame:
    """(job_id, candidate_id, semantic_score) of all jobs (job_id, label, a) and candidates (candidate_id, label, b) of equal labels.

    All pairs are given out, so rows grow with their number; vectors meet in blocks, BLOCKS_AT_ONCE of a label's candidates below one key,
    so that neither a task's memory nor the shuffle does.
    """
    theirs = settled(_in_blocks(cands, "candidate_id", label, "theirs", "b").withColumn("part", F.floor(F.col("block") / BLOCKS_AT_ONCE)).select(label, "part", "theirs"), "candidate-blocks")
    parts = theirs.groupBy(label).agg(F.max("part").alias("last"))
    mine = _in_blocks(jobs, "job_id", label, "mine", "a").join(parts, label).select(label, F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("part"), "mine")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one, two = (batch.column(c)[i].values for c in ("mine", "theirs"))
                x, y = (t.field("id").to_numpy() for t in (one, two))
                scores = _cosines(one.field("v").to_pylist(), two.field("v").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, len(y))), pa.array(np.tile(y, len(x))), pa.array(scores.ravel())], names=["job_id", "candidate_id", "semantic_score"])

    met = mine.join(theirs, [label, "part"]).select("mine", "theirs")
    return met.mapInArrow(run, "job_id long, candidate_id long, semantic_score double")


def knowledge_skills(definitions: DataFrame, texts: DataFrame, least: float = 0.75) -> DataFrame:
    """(candidate_id, skill): texts (candidate_id, text) that are like a skill's definition (skill, definition) by their words.

    Words meet in an equi join, so that a pair without a common word costs nothing; twice the share of the definition's words that a
    text holds must be above `least`. The definitions' words go to the texts, WORDS_AT_ONCE at a time with a pass over the texts for each
    part, so that common words are never brought together and a text's words are counted where it lies.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z0-9+#.-]{2,}"), F.lit(0)))
    # a table first: otherwise the words of all documents are sought before those of definitions are chosen
    defined = settled(definitions.select("skill", "definition"), "definitions").select("skill", words("definition").alias("w"))
    parts = -(-(defined.agg(F.sum(F.size("w"))).first()[0] or 1) // WORDS_AT_ONCE)
    wanted = settled(defined.select("skill", F.size("w").alias("size"), F.pmod(F.xxhash64("skill"), F.lit(parts)).alias("part"), F.explode("w").alias("word")), "words")
    have = texts.select("candidate_id", F.explode(words("text")).alias("word"))
    found = []
    for i in range(parts):
        some = wanted.where(F.col("part") == i).drop("part")
        both = have.join(F.broadcast(some), "word").groupBy("candidate_id", "skill", "size").agg(F.count("*").alias("n"))
        found.append(both.where(F.least(F.lit(1.0), 2.0 * F.col("n") / F.col("size")) > least).select("candidate_id", "skill"))
    return reduce(DataFrame.unionByName, found)


def knn(queries: DataFrame, vecs: DataFrame, k: int, block_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """(query_id, entity_id, similarity, rank): the k nearest rows of each query (query_id, vector) by cosine.

    Queries go to the tasks in blocks of a bounded size. A task keeps its best k of each query, so that a query's
    candidates are k per task before the final window. A zero query finds nothing; ties go to the lower id.
    """
    spark = vecs.sparkSession
    n = queries.count()
    dim = (queries.select(F.max(F.size("vector"))).first()[0] or 1) if n else 1
    per_block = max(1, block_bytes // (8 * dim))
    found = None
    for part in range(-(-n // per_block)):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-n // per_block))) == part).collect()
        ids = np.array([r["query_id"] for r in rows if any(r["vector"])], np.int64)
        if not len(ids):
            continue
        q = np.array([r["vector"] for r in rows if any(r["vector"])], np.float64)
        shared = spark.sparkContext.broadcast((ids, q / np.linalg.norm(q, axis=1, keepdims=True)))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, q = shared.value
            held = [(np.full((len(b), 0), -2.0), np.zeros((len(b), 0), np.int64)) for b in (ids[i : i + QUERIES_AT_ONCE] for i in range(0, len(ids), QUERIES_AT_ONCE))]
            step = max(1, SCORE_CELLS // min(len(ids), QUERIES_AT_ONCE))
            for batch in batches:
                at, x = _matrix(batch.column(1), q.shape[1])
                names, x = batch.column(0).to_numpy(zero_copy_only=False)[at], _unit(x)
                for i in range(0, len(x), step):
                    for j, (score, name) in enumerate(held):
                        s = np.round(q[j * QUERIES_AT_ONCE : (j + 1) * QUERIES_AT_ONCE] @ x[i : i + step].T, 9)
                        new = np.broadcast_to(names[i : i + step], s.shape)
                        if score.shape[1] < k:
                            held[j] = _best(np.hstack([score, s]), np.hstack([name, new]), k)
                        else:  # most queries have k better rows already
                            to = np.flatnonzero(~(s.max(axis=1) < score[:, -1]))
                            score[to], name[to] = _best(np.hstack([score[to], s[to]]), np.hstack([name[to], new[to]]), k)
            for j, (score, name) in enumerate(held):
                if score.shape[1]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[j * QUERIES_AT_ONCE :][: len(score)], score.shape[1])), pa.array(name.ravel()), pa.array(score.ravel())], names=["query_id", "entity_id", "similarity"])

        some = vecs.select(F.col("entity_id").cast("long"), "vector").mapInArrow(best, "query_id long, entity_id long, similarity double")
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = spark.createDataFrame([], "query_id long, entity_id long, similarity double")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "entity_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def cluster_vectors(vecs: DataFrame, n: int, sample: int = 8192, rounds: int = 5) -> tuple[DataFrame, np.ndarray]:
    """vecs (entity_id, vector) of n clusters: (entity_id, vector, cluster, off), off the distance of the unit vector to its centre; and the centres.

    Centres are fitted on `sample` rows at most; every row is put to the nearest one. Rows without a direction have cluster -1; those of
    another width than most of the sample, null, or with components that are no numbers are left out.
    """
    usable = vecs.select(F.col("entity_id").cast("long").alias("entity_id"), F.col("vector").cast("array<double>").alias("vector"))
    usable = usable.where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = usable.where(F.exists("vector", lambda x: x != 0)).orderBy(F.xxhash64("entity_id"), "entity_id").limit(sample).collect()
    widths = [len(r["vector"]) for r in rows]
    width = max(set(widths), key=widths.count, default=1)
    x = _unit(np.array([r["vector"] for r in rows if len(r["vector"]) == width], np.float64).reshape(-1, width))
    centres = x[:n]
    for _ in range(rounds if len(x) else 0):
        near = (x @ centres.T).argmax(axis=1)
        centres = _unit(np.array([x[near == i].mean(axis=0) if (near == i).any() else c for i, c in enumerate(centres)]))
    shared = vecs.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shared.value
        for batch in batches:
            at, raw = _matrix(batch.column(1), centres.shape[1])
            if len(at):
                u = _unit(raw)
                near = (u @ centres.T).argmax(axis=1)
                none = ~raw.any(axis=1)
                off = np.linalg.norm(u - centres[near], axis=1)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), _lists(u), pa.array(np.where(none, -1, near).astype(np.int32)), pa.array(np.where(none, 0.0, off))], names=["entity_id", "vector", "cluster", "off"])

    return settled(usable.mapInArrow(place, "entity_id long, vector array<double>, cluster int, off double"), "clusters"), centres


CHUNK_ROWS, QUERY_ROWS = 1 << 15, 1 << 13


def _scan(wanted: DataFrame, clustered: DataFrame, sizes: dict[int, int], k: int) -> DataFrame:
    """(query_id, entity_id, similarity): the best k of each query in each chunk of each cluster that it wants (query_id, vector, cluster)."""
    chunks = F.element_at(F.create_map(*[F.lit(v) for c, n in (sizes or {-1: 1}).items() for v in (c, -(-n // CHUNK_ROWS))]), F.col("cluster"))
    mine = clustered.select("cluster", F.pmod(F.xxhash64("entity_id"), chunks).cast("int").alias("chunk"), "entity_id", "vector")
    blocks = wanted.groupBy("cluster").agg(F.ceil(F.count("*") / QUERY_ROWS).cast("int").alias("blocks"))
    theirs = wanted.join(blocks, "cluster").select("cluster", F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int").alias("block"), "query_id", "vector")
    mine = mine.join(blocks, "cluster").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def best(q: pa.Table, v: pa.Table) -> pa.Table:
        out = []
        if q.num_rows and v.num_rows:
            (_, x), ids, to = _matrix(v["vector"], len(v["vector"][0])), v["entity_id"].to_numpy(), q["query_id"].to_numpy()
            step = max(1, SCORE_CELLS // len(ids))
            for i in range(0, len(to), step):
                _, some = _matrix(q["vector"].slice(i, step), x.shape[1])
                s = np.round(some @ x.T, 9)
                score, name = _best(s, np.broadcast_to(ids, s.shape), k)
                out.append((np.repeat(to[i : i + step], score.shape[1]), name.ravel(), score.ravel()))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "entity_id", "similarity"), columns)))

    by = ["cluster", "chunk", "block"]
    return theirs.groupBy(by).cogroup(mine.groupBy(by)).applyInArrow(best, "query_id long, entity_id long, similarity double")


def knn_pruned(queries: DataFrame, clustered: DataFrame, centres: np.ndarray, k: int) -> tuple[DataFrame, DataFrame]:
    """As knn, of cluster_vectors' table: (query_id, entity_id, similarity, rank), and the clusters that were read (query_id, cluster).

    The clusters nearest to a query that hold k vectors give a bound of its k-th distance; of the others only those are read whose centre less
    whose radius is within it (triangle inequality), so nothing is lost. How much is left out depends on how well the vectors cluster:
    nothing for vectors in all directions, most for topics that lie apart.
    """
    stats = clustered.groupBy("cluster").agg(F.count("*").alias("n"), F.max("off").alias("radius")).collect()
    sizes, radius = {r["cluster"]: r["n"] for r in stats}, {r["cluster"]: r["radius"] for r in stats}
    shared = queries.sparkSession.sparkContext.broadcast((centres, sizes, radius))

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, sizes, radius = shared.value
        held = [c for c in range(len(centres)) if c in sizes]
        n, reach = np.array([sizes[c] for c in held], np.int64), np.array([radius[c] for c in held], np.float64)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                at, raw = _matrix(part.column(1), centres.shape[1])
                at, raw = at[raw.any(axis=1)], raw[raw.any(axis=1)]
                if not len(at):
                    continue
                u = _unit(raw)
                away = np.linalg.norm(centres[held][None] - u[:, None], axis=2)
                order = np.argsort(away, axis=1)
                least = np.maximum(0.0, np.take_along_axis(away - reach, order, 1))
                before = np.cumsum(n[order], axis=1) - n[order]
                cluster = np.array(held, np.int32)[order]
                if -1 in sizes:  # of similarity 0, a distance of the square root of 2
                    last = np.full((len(u), 1), 1.0)
                    cluster, least, before = np.hstack([cluster, -last.astype(np.int32)]), np.hstack([least, last * 2**0.5]), np.hstack([before, np.full((len(u), 1), n.sum())])
                row = np.repeat(np.arange(len(u)), cluster.shape[1])
                ids = part.column(0).take(pa.array(at[row]))
                yield pa.RecordBatch.from_arrays([ids, _lists(u[row]), pa.array(cluster.ravel()), pa.array(least.ravel()), pa.array((before < k).ravel())], names=["query_id", "vector", "cluster", "least", "first"])

    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    planned = settled(rows.mapInArrow(plan, "query_id long, vector array<double>, cluster int, least double, first boolean"), "planned")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "entity_id")
    near = settled(_scan(planned.where("first").select("query_id", "vector", "cluster"), clustered, sizes, k), "near")
    kth = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select("query_id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity"))).alias("bound"))
    rest = settled(planned.where("NOT first").join(kth, "query_id", "left").where(F.coalesce(F.col("least") <= F.col("bound") + 1e-6, F.lit(True))).select("query_id", "vector", "cluster"), "rest")
    found = near.unionByName(_scan(rest, clustered, sizes, k)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found, planned.where("first").select("query_id", "cluster").unionByName(rest.select("query_id", "cluster"))


def knn_routed(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """As knn, of queries (query_id, language, vector) and docs (entity_id, vector, multilingual): an Arabic query is compared with a row's multilingual
    vector, or with its standard one where it has none, any other query the other way round. A vector of another width than the
    query's isn't compared.
    """
    widths = [r[0] for r in queries.where("vector IS NOT NULL").select(F.size("vector")).distinct().collect()]
    found = queries.sparkSession.createDataFrame([], "query_id long, entity_id long, similarity double, rank int")
    arabic = F.coalesce(F.col("language") == "ar", F.lit(False))
    for width in sorted(widths):
        for is_arabic, order in ((True, ("multilingual", "vector")), (False, ("vector", "multilingual"))):
            some = queries.where((F.size("vector") == width) & (arabic == is_arabic)).select("query_id", "vector")
            rows = docs.select("entity_id", F.coalesce(*order).alias("vector")).where(F.size("vector") == width)
            found = found.unionByName(knn(some, rows, k))
    return found


def embed_texts(df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray] | None = None, dim: int = 64) -> DataFrame:
    """df with vector, a unit vector per text; by default seeded with the text's SHA-256, the zero vector below three letters or digits."""

    def seeded(texts: list[str]) -> np.ndarray:
        import hashlib

        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            if sum(c.isalnum() for c in t) >= 3:
                v = np.random.default_rng(int.from_bytes(hashlib.sha256(t.encode()).digest()[:8], "big")).standard_normal(dim)
                out[i] = v / np.linalg.norm(v)
        return out

    encode = encoder or seeded

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(vector=list(encode(f[text].fillna("").tolist())))

    from pyspark.sql import types as T

    return df.mapInPandas(run, T.StructType([*df.schema.fields, T.StructField("vector", T.ArrayType(T.DoubleType()))]))


def embed_distinct(df: DataFrame, text: str, encoder: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """df with vector; each different text is encoded once."""
    hashed = df.withColumn("text_hash", F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))
    once = embed_texts(hashed.groupBy("text_hash").agg(F.min(text).alias("once")), "once", encoder).drop("once")
    return hashed.join(once, "text_hash")


def embedding_metadata(df: DataFrame, text: str, model: str, multilingual: str) -> DataFrame:
    """df with source_hash, language (ar by its letters, else the lang column, else en) and the model for it."""
    language = F.when(F.col(text).rlike("[\\u0600-\\u06FF\\u0750-\\u077F]"), "ar").otherwise(F.coalesce("lang", F.lit("en")))
    return df.withColumns({"source_hash": F.sha2(F.col(text).cast("binary"), 256), "language": language}).withColumn("model_name", F.when(F.col("language") == "ar", multilingual).otherwise(model))


def stale_embeddings(entities: DataFrame, stored: DataFrame) -> DataFrame:
    """Entities without a stored vector of the same model and source."""
    old = stored.select("entity_id", F.col("model_name").alias("old_model"), F.col("source_hash").alias("old_hash"))
    joined = entities.join(old, "entity_id", "left")
    return joined.where(~(F.col("model_name").eqNullSafe(F.col("old_model")) & F.col("source_hash").eqNullSafe(F.col("old_hash")))).drop("old_model", "old_hash")


def skill_definitions(skills: DataFrame, docs: DataFrame) -> DataFrame:
    """(skill, doc_id, score): the best skill document of each: tag 3, title 2, content 1; the lowest id of equals.

    Tags are joined on the skill; titles and contents through their words' n-grams, so no pair is scanned.
    """
    from .text import grams

    of_skill = docs.where("category = 'skill'").select("doc_id", "title", "content", "tag")
    wanted = skills.select("skill").distinct()
    longest = wanted.agg(F.max(F.size(F.split("skill", " ")))).first()[0] or 1
    tag = of_skill.join(wanted, F.col("tag") == F.col("skill")).select("skill", "doc_id", F.lit(3).alias("score"))
    title = grams(of_skill, "title", "doc_id", longest).join(wanted, F.col("gram") == F.col("skill")).select("skill", "doc_id", F.lit(2).alias("score"))
    body = grams(of_skill, "content", "doc_id", longest).join(wanted, F.col("gram") == F.col("skill")).select("skill", "doc_id", F.lit(1).alias("score"))
    return tag.unionByName(title).unionByName(body).groupBy("skill").agg(F.max_by(F.struct("doc_id", "score"), F.struct(F.col("score"), -F.col("doc_id"))).alias("m")).select("skill", "m.doc_id", "m.score")


def lexical_overlap(a: Column, definition: Column) -> Column:
    """At most 1: twice the shared words over the definition's words."""
    return F.when(F.size(definition) > 0, F.least(F.lit(1.0), 2.0 * F.size(F.array_intersect(a, definition)) / F.size(definition))).otherwise(0.0)
