"""JSON texts whose fields may be of several kinds, read as VARIANT: taxonomies, extra skills, answers of language models.

A text that is no JSON, or a field of an unforeseen kind, is a null or a default, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import clamp, norm_name

#: Fields of an evaluation, all of which it must have and no others; what stands where it isn't valid; limits.
EVALUATION = ["clarity", "completeness", "feedback", "language_detected", "score", "strengths", "technical_accuracy", "weaknesses"]
NO_EVALUATION, NOT_FOUND = "Evaluation complete.", "not found"
MOST_ITEMS, ITEM_LENGTH, FEEDBACK_LENGTH, TEXT_LENGTH = 6, 160, 1000, 500


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _kind(v: Column, path: str) -> Column:
    """STRING, ARRAY..., OBJECT... and so on; null where nothing is."""
    return F.schema_of_variant(_get(v, path, "variant"))


def _texts(v: Column, path: str) -> Column:
    """A list of texts, or one text as a list of one; else null."""
    kind = _kind(v, path)
    return F.when(kind.startswith("ARRAY"), _get(v, path, "array<string>")).when(kind == "STRING", F.array(_get(v, path, "string")))


def taxonomy(docs: DataFrame) -> dict[str, DataFrame]:
    """Of documents (doc: JSON text with `skills` and `skillGroups`): nodes (uri, preferred, description, skill_type), labels (uri, label, kind, seq),
    edges (skill, related, relation) and groups (cluster, name, parent, skill).

    A label is a text or an object of languages, alternative labels a text, a list or an object of lists; English comes before Arabic. Skills
    without a uri or a label are left out.
    """
    v = F.col("v")
    whole = docs.select(F.try_parse_json("doc").alias("d"))
    skills = whole.select(F.explode(_get(F.col("d"), "$.skills", "array<variant>")).alias("v"))
    label = F.when(_kind(v, "$.preferredLabel") == "STRING", _get(v, "$.preferredLabel", "string")).otherwise(
        F.coalesce(F.nullif(_get(v, "$.preferredLabel.en", "string"), F.lit("")), _get(v, "$.preferredLabel.ar", "string"))
    )
    none = F.array().cast("array<string>")
    other = F.coalesce(_texts(v, "$.altLabels"), F.concat(F.coalesce(_texts(v, "$.altLabels.en"), none), F.coalesce(_texts(v, "$.altLabels.ar"), none)))
    good = skills.select(
        _get(v, "$.uri", "string").alias("uri"), label.alias("preferred"), other.alias("alt"), _get(v, "$.description", "string").alias("description"),
        F.coalesce(_get(v, "$.skillType", "string"), F.lit("skill")).alias("skill_type"), *[F.coalesce(_texts(v, f"$.{r}"), none).alias(r) for r in ("broader", "narrower", "related")],
    ).where("uri <> '' AND preferred <> ''")
    first = good.select("uri", F.col("preferred").alias("label"), F.lit("preferred").alias("kind"), F.lit(0).alias("seq"))
    to = lambda r: F.transform(r, lambda x: F.struct(x.alias("related"), F.lit(r).alias("relation")))
    hops = F.concat(*[to(r) for r in ("broader", "narrower", "related")])
    group = whole.select(F.explode(_get(F.col("d"), "$.skillGroups", "array<variant>")).alias("v"))
    return {
        "nodes": good.select("uri", "preferred", "description", "skill_type"),
        "labels": first.unionByName(good.select("uri", F.posexplode("alt").alias("seq", "label")).select("uri", "label", F.lit("alt").alias("kind"), "seq")),
        "edges": good.select(F.col("uri").alias("skill"), F.explode(hops).alias("x")).select("skill", "x.related", "x.relation"),
        "groups": group.select(*[_get(v, f"$.{f}", "string").alias(n) for f, n in (("id", "cluster"), ("label", "name"), ("parent", "parent"))], F.explode_outer(_texts(v, "$.skills")).alias("skill")),
    }


def extra_skills(docs: DataFrame, catalog: DataFrame) -> DataFrame:
    """(category, skill) of documents (doc) of lists by category, below `categories` or bare, that the catalog (skill, category) lacks in that category."""
    parsed = F.try_parse_json("doc")
    inner = _get(parsed, "$.categories", "map<string,variant>")
    lists = docs.select(F.explode(F.coalesce(inner, _get(parsed, "$", "map<string,variant>"))).alias("category", "v"))
    new = lists.select("category", F.explode(F.when(_kind(F.col("v"), "$").startswith("ARRAY"), _get(F.col("v"), "$", "array<string>"))).alias("skill"))
    new = new.select("category", norm_name("skill").alias("skill")).where("skill <> ''").distinct()
    return new.join(catalog.select("category", norm_name("skill").alias("skill")), ["category", "skill"], "left_anti")


def json_within(text: Column) -> Column:
    """The JSON object of a model's answer, which may be fenced or stand within prose."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    return F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)\{.*\}", 0))


def _share(v: Column, path: str) -> Column:
    """A number within 0 and 1; 0.5 where there is none."""
    return F.coalesce(clamp(_get(v, path, "double")), F.lit(0.5))


def _bounded(c: Column, default: str, length: int) -> Column:
    return F.coalesce(F.substring(F.nullif(F.trim(c), F.lit("")), 1, length), F.lit(default))


def evaluations(df: DataFrame, text: str) -> DataFrame:
    """df with score, feedback, strengths, weaknesses, technical_accuracy, completeness and clarity of a model's answer, the defaults
    where it isn't an evaluation: all fields, no others, texts and lists of texts where these belong."""
    v = F.col("_v")
    keys = F.array_sort(F.map_keys(_get(v, "$", "map<string,variant>")))
    lists = [_kind(v, f"$.{c}").isin("ARRAY<STRING>", "ARRAY<VOID>") for c in ("strengths", "weaknesses")]
    valid = F.coalesce((keys == F.array(*[F.lit(k) for k in EVALUATION])) & (_kind(v, "$.feedback") == "STRING") & (_kind(v, "$.language_detected") == "STRING") & lists[0] & lists[1], F.lit(False))
    none = F.array().cast("array<string>")
    some = lambda c: F.when(valid, F.transform(F.filter(F.slice(F.transform(_get(v, f"$.{c}", "array<string>"), lambda s: F.trim(s)), 1, MOST_ITEMS), lambda s: s != ""), lambda s: F.substring(s, 1, ITEM_LENGTH))).otherwise(none)
    out = {c: F.when(valid, _share(v, f"$.{c}")).otherwise(0.5) for c in ("score", "technical_accuracy", "completeness", "clarity")}
    out["feedback"] = F.when(valid, _bounded(_get(v, "$.feedback", "string"), NO_EVALUATION, FEEDBACK_LENGTH)).otherwise(NO_EVALUATION)
    return df.withColumn("_v", F.try_parse_json(json_within(F.col(text)))).withColumns(out | {c: some(c) for c in ("strengths", "weaknesses")}).drop("_v")


def cv_skills(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, skill, context, status, level, years, confidence) of the skills that a model's answer names."""
    v = F.col("v")
    rows = df.select(key, F.posexplode(_get(F.try_parse_json(json_within(F.col(text))), "$.skills_with_context", "array<variant>")).alias("pos", "v")).where(_kind(v, "$.skill") == "STRING")
    field = lambda c, default: _bounded(F.coalesce(_get(v, f"$.{c}", "string"), F.lit(default)), NOT_FOUND, TEXT_LENGTH).alias(c)
    years = clamp(_get(v, "$.years", "double"), 0.0, 60.0)
    return rows.select(key, "pos", field("skill", NOT_FOUND), field("context", NOT_FOUND), field("status", "unknown"), field("level", "unknown"), years.alias("years"), _share(v, "$.confidence").alias("confidence"))
