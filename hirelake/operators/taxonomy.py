"""A skill taxonomy: labels, relations, fuzzy names, similarity."""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fuzzy import name_ratio, partial_ratio
from ..functions.scalar import in_order, norm_name
from ..sources.tables import settled

FUZZY_AT = 0.7
QUERIES_AT_ONCE = 2_000

#: Relation -> similarity, in order of preference.
RELATIONS = [("synonym", 0.95), ("broader", 0.70), ("narrower", 0.75), ("related", 0.60)]


def load_taxonomy(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of JSON rows (uri, label {en, ar}, alt [..], category): nodes, and labels (uri, label, kind, seq)."""
    label = F.coalesce("label.en", "label.ar")
    good = nodes.withColumn("preferred", label).where("uri IS NOT NULL AND trim(preferred) <> ''")
    first = good.select("uri", F.col("preferred").alias("label"), F.lit("preferred").alias("kind"), F.lit(0).alias("seq"))
    others = good.select("uri", F.posexplode("alt").alias("seq", "label")).select("uri", "label", F.lit("alt").alias("kind"), "seq")
    return good.select("uri", "preferred", "category"), first.unionByName(others)


def label_index(labels: DataFrame) -> DataFrame:
    """(label, uri): the last preferred label of a name wins, else the first alternative; by uri and place."""
    kind = F.when(F.col("kind") == "preferred", 0).otherwise(1)
    order = Window.partitionBy(norm_name("label")).orderBy(kind, F.when(F.col("kind") == "preferred", F.col("uri")).desc(), "uri", "seq")
    return labels.withColumn("rn", F.row_number().over(order)).where("rn = 1").select(norm_name("label").alias("label"), "uri")


def catalog_as_taxonomy(catalog: DataFrame) -> DataFrame:
    return catalog.select(F.concat(F.lit("local:"), F.regexp_replace("skill", " ", "-")).alias("uri"), F.col("skill").alias("preferred"), "category", F.lit(0.9).alias("confidence"))


def normalize_exact(skills: DataFrame, index: DataFrame) -> DataFrame:
    return skills.withColumn("label", norm_name("skill")).join(index, "label").select("skill", "uri")


def _pairs_of_letters(c: Column) -> Column:
    """The different pairs of neighbouring characters of a name between two line ends."""
    padded = F.concat(F.lit("\n"), c, F.lit("\n"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) + 1), lambda i: F.substr(padded, i, F.lit(2))))


def normalize_fuzzy(skills: DataFrame, index: DataFrame, least: int = 85) -> DataFrame:
    """(skill, uri, confidence): the label of best Indel ratio, at least `least`; the first label of equals.

    A character that is put in or taken out breaks two pairs of neighbours at most. So of a name's rarest pairs, a few more than can be
    broken, one at least is the label's too: an equi join on these gives the candidates, and frequent pairs seldom are among them. Lengths
    and Levenshtein's bound come next; they lose nothing either.
    """
    if least < 75:
        raise ValueError("names of a ratio below 75 may share no pair of characters")
    r = least / 100
    names = skills.select("skill").distinct().withColumn("a", norm_name("skill"))
    labels = index.select("label", "uri").distinct().select("label", "uri", F.explode(_pairs_of_letters(F.col("label"))).alias("pair"))
    often = labels.groupBy("pair").agg(F.count("*").alias("n"))
    mine = names.select("skill", "a", F.explode(_pairs_of_letters(F.col("a"))).alias("pair")).join(often, "pair", "left")
    rare = mine.groupBy("skill", "a").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pair"))).alias("pairs"))
    broken = F.floor(F.length("a") * (4 * (1 - r) / (2 - r)) + 1e-9).cast("int")
    near = rare.select("skill", "a", F.explode(F.slice("pairs", F.lit(1), broken + 1)).alias("p")).select("skill", "a", "p.pair").join(labels, "pair")
    both = F.length("a") + F.length("label")
    close = near.where(F.abs(F.length("a") - F.length("label")) <= both * (1 - r)).select("skill", "a", "label", "uri").distinct()
    scored = close.where(1 - F.levenshtein("a", "label") / both >= r).withColumn("ratio", name_ratio("a", "label")).where(F.col("ratio") >= r)
    order = Window.partitionBy("skill").orderBy(F.desc("ratio"), "label", "uri")
    return scored.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("skill", "uri", F.round("ratio", 4).alias("confidence"))


def normalized(skills: DataFrame, index: DataFrame, least: int = 85) -> DataFrame:
    """(skill, uri): by name, else by the nearest label."""
    exact = normalize_exact(skills.select("skill").distinct(), index)
    return exact.unionByName(normalize_fuzzy(skills.select("skill").distinct().join(exact, "skill", "left_anti"), index, least).select("skill", "uri"))


def similarity_cascade(pairs: DataFrame, index: DataFrame, nodes: DataFrame, edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """pairs (a, b) with similarity, by the first that holds: equal names 1; both unknown, their names' ratio; one unknown, half its ratio with
    the other's preferred label; one entry 1; a relation's value; one cluster .5; .3 of the ratio of the preferred labels.

    index (label, uri), nodes (uri, preferred), edges (skill, related: uris; relation), clusters (uri, cluster).
    """
    value = F.lit(0.0)
    for name, similarity in RELATIONS:
        value = F.when(F.col("relation") == name, similarity).otherwise(value)
    clean = pairs.select("a", "b").distinct().where("a IS NOT NULL AND b IS NOT NULL AND trim(a) <> '' AND trim(b) <> ''")
    known = normalized(clean.select(F.explode(F.array("a", "b")).alias("skill")), index).join(nodes.select("uri", F.lower("preferred").alias("preferred")), "uri").join(clusters.select("uri", "cluster"), "uri", "left")
    of = lambda c: known.select(F.col("skill").alias(c), F.col("uri").alias(f"u_{c}"), F.col("preferred").alias(f"p_{c}"), F.col("cluster").alias(f"c_{c}"))
    hops = edges.groupBy(F.col("skill").alias("u_a"), F.col("related").alias("u_b")).agg(F.max(value).alias("of_relation"))
    rows = clean.join(of("a"), "a", "left").join(of("b"), "b", "left").join(hops, ["u_a", "u_b"], "left").withColumns({"x": norm_name("a"), "y": norm_name("b")})
    none_a, none_b = F.col("u_a").isNull(), F.col("u_b").isNull()
    rows = rows.withColumns({"left": F.when(none_a, F.col("x")).otherwise(F.col("p_a")), "right": F.when(none_b, F.col("y")).otherwise(F.col("p_b"))}).withColumn("ratio", name_ratio("left", "right"))
    out = (
        F.when(F.col("x") == F.col("y"), 1.0).when(none_a & none_b, F.col("ratio")).when(none_a | none_b, 0.5 * F.col("ratio")).when(F.col("u_a") == F.col("u_b"), 1.0)
        .when(F.col("of_relation").isNotNull(), F.col("of_relation")).when(F.col("c_a") == F.col("c_b"), 0.5).otherwise(0.3 * F.col("ratio"))
    )
    return rows.select("a", "b", F.round(out, 4).alias("similarity"))


def skill_cluster(skills: DataFrame, clusters: DataFrame) -> DataFrame:
    """skills (skill, ...) with the cluster (skill, cluster) of each, null for an unknown one."""
    return skills.join(clusters.select("skill", "cluster"), "skill", "left")


def same_cluster(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with whether both skills are of one cluster; an unknown skill is of none."""
    of = lambda c: clusters.select(F.col("skill").alias(c), F.col("cluster").alias(f"c_{c}"))
    same = F.coalesce(F.col("c_a") == F.col("c_b"), F.lit(False))
    return pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").withColumn("same", same).drop("c_a", "c_b")


def enrich(shown: DataFrame, profile: DataFrame) -> DataFrame:
    """(candidate_id, added): skills that the text shows and the profile lacks, sorted and joined by commas."""
    new = shown.select("candidate_id", "skill").distinct().join(profile.select("candidate_id", "skill"), ["candidate_id", "skill"], "left_anti")
    return new.groupBy("candidate_id").agg(in_order("skill", "skill").alias("added"))


def related(skills: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """(skill, related, relation, similarity): one hop; `depth` broader and twice as many related ones; each once, in relation order."""
    rank, value = F.lit(9), F.lit(0.0)
    for i, (name, similarity) in enumerate(RELATIONS):
        rank = F.when(F.col("relation") == name, i).otherwise(rank)
        value = F.when(F.col("relation") == name, similarity).otherwise(value)
    hops = skills.select("skill").distinct().join(edges, "skill").withColumns({"r": rank, "similarity": value})
    place = F.row_number().over(Window.partitionBy("skill", "relation").orderBy("related"))
    some = hops.withColumn("p", place).where(~((F.col("relation") == "broader") & (F.col("p") > depth)) & ~((F.col("relation") == "related") & (F.col("p") > 2 * depth)))
    return some.groupBy("skill", "related").agg(F.min_by(F.struct("relation", "similarity"), "r").alias("m")).select("skill", "related", "m.relation", "m.similarity")


def skill_similarity(pairs: DataFrame, edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """pairs (a, b) with similarity: equal 1, a relation's value, the same cluster .5, else .3 of the names' ratio."""
    value = F.lit(0.0)
    for name, similarity in RELATIONS:
        value = F.when(F.col("relation") == name, similarity).otherwise(value)
    known = edges.groupBy(F.col("skill").alias("a"), F.col("related").alias("b")).agg(F.max(value).alias("of_relation"))
    of = lambda c: clusters.select(F.col("skill").alias(c), F.col("category").alias(f"c_{c}"))
    joined = pairs.join(known, ["a", "b"], "left").join(of("a"), "a", "left").join(of("b"), "b", "left")
    same = F.coalesce(F.col("c_a") == F.col("c_b"), F.lit(False))
    out = F.when(F.col("a") == F.col("b"), 1.0).when(F.col("of_relation").isNotNull(), F.col("of_relation")).when(same, 0.5).otherwise(F.round(0.3 * name_ratio("a", "b"), 4))
    return joined.select("a", "b", out.alias("similarity"))


def search_score(query: Column, label: Column) -> Column:
    """1 for equal names, the share of the label that a contained query makes up, else null."""
    return F.when(query == label, 1.0).when(label.contains(query), F.length(query) / F.length(label))


def search_taxonomy(queries: DataFrame, index: DataFrame, n: int) -> DataFrame:
    """(query, label, score, rank): the n best equal or containing labels; they are found by the query's first three characters."""
    width = F.least(F.lit(3), F.length("query"))
    wanted = queries.select("query").distinct().where(F.length("query") > 0).withColumn("part", F.substr("query", F.lit(1), width))
    cut = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("label") - (k - 1), F.lit(1))), lambda i: F.substr(F.col("label"), i, F.lit(k)))
    parts = index.select("label").distinct().select("label", F.explode(F.array_distinct(F.concat(cut(1), cut(2), cut(3)))).alias("part"))
    found = wanted.join(parts, "part").where(F.col("label").contains(F.col("query"))).withColumn("score", search_score(F.col("query"), F.col("label")))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "label"))).where(F.col("rank") <= n).select("query", "label", "score", "rank")


def search_fuzzy(queries: DataFrame, labels: DataFrame, n: int, category: str | None = None) -> DataFrame:
    """(query, label, score, rank): the n best labels (label, category) of each query: 1 for an equal one, the query's share of one that holds it,
    else 0.8 of a partial ratio of FUZZY_AT or more.

    Labels of another category are left out, those of none are not. Queries go to the tasks QUERIES_AT_ONCE at a time. A label is compared
    with those that it has enough characters in common with; a task keeps the best n of each query.
    """
    wanted = queries.select(F.lower(F.trim("query")).alias("query")).where("query <> ''").distinct()
    rows = labels if category is None else labels.where(F.col("category").isNull() | (F.lower("category") == category.lower()))
    rows = rows.select(F.lower(F.trim("label")).alias("label")).where("label <> ''").distinct()
    parts = -(-wanted.count() // QUERIES_AT_ONCE)
    found = labels.sparkSession.createDataFrame([], "query string, label string, score double")
    for i in range(parts):
        shared = labels.sparkSession.sparkContext.broadcast(sorted(r["query"] for r in wanted.where(F.pmod(F.xxhash64("query"), F.lit(parts)) == i).collect()))

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            names = shared.value
            letters = np.array([_letters(q) for q in names])
            size = np.array([len(q) for q in names])
            best: list[list[tuple[float, str]]] = [[] for _ in names]
            for b in batches:
                for label in b.column(0).to_pylist():
                    # of two names a partial ratio r needs r / (2 - r) of the shorter one's characters in common
                    enough = np.minimum(letters, _letters(label)).sum(axis=1) >= FUZZY_AT / (2 - FUZZY_AT) * np.minimum(size, len(label)) - 1e-9
                    for at in np.flatnonzero(enough):
                        q = names[at]
                        near = partial_ratio(q, label) if q not in label else 0.0
                        score = 1.0 if q == label else len(q) / len(label) if q in label else 0.8 * near if near >= FUZZY_AT else 0.0
                        if score:
                            insort(best[at], (-score, label))
                            del best[at][n:]
            rows = [(q, label, -score) for q, held in zip(names, best) for score, label in held]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate((pa.string(), pa.string(), pa.float64()))], names=["query", "label", "score"])

        part = rows.mapInArrow(run, "query string, label string, score double")
        found = found.unionByName(part if parts == 1 else settled(part, "searched"))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "label"))).where(F.col("rank") <= n)


def _letters(name: str) -> np.ndarray:
    """How often a name has the characters of each of 64 kinds."""
    return np.bincount([ord(c) % 64 for c in name], minlength=64)


def merge_taxonomy(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new.join(old, "uri", "left_anti"))
