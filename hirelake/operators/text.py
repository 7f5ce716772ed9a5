"""From text to profiles: skills, mentions, sections, contacts, entries."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import Names
from ..functions.scalar import norm_text
from ..sources.tables import settled

#: Characters around a mention that are looked at, and the most mentions of a skill in a text that isn't stuffed with it.
AROUND = 80
MOST_MENTIONS = 10
#: First words of names that go to the tasks at most, and texts that become one Arrow batch of mentions.
MOST_HEADS = 100_000
TEXTS_AT_ONCE = 256
NAMES_AT_ONCE = 20_000
TOKEN = re.compile(r"[a-z0-9+#.]+")
GAP, BEFORE, AFTER = re.compile(r"[\s/-]+"), re.compile(r"[\w+#./-]"), re.compile(r"[\w+#/-]|\.\w")


def grams(df: DataFrame, text: str, key: str, longest: int = 1, lengths: list[int] | None = None) -> DataFrame:
    """(key, gram) of the normalised text's word n-grams, up to `longest` or of the lengths given, repeats included; also without closing dots, as a sentence ends."""

    def runs(n: int) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))
        return some if n == 1 else F.when(F.size("w") >= n, some).otherwise(F.array().cast("array<string>"))

    exploded = df.select(key, F.split(norm_text(text), " ").alias("w")).select(key, F.explode(F.concat(*[runs(n) for n in lengths or range(1, longest + 1)])).alias("gram"))
    dotted = F.col("gram").endswith(".")
    return exploded.select(key, F.explode(F.when(dotted, F.array("gram", F.regexp_replace("gram", "\\.+$", ""))).otherwise(F.array("gram"))).alias("gram"))


def names(catalog: DataFrame, aliases: DataFrame) -> DataFrame:
    """(gram, name, skill): what stands for a skill in normalised text, and as it is written."""
    both = catalog.select(F.col("skill").alias("name"), "skill").unionByName(aliases.select(F.col("alias").alias("name"), F.col("canonical").alias("skill")))
    return both.select(norm_text("name").alias("gram"), F.lower(F.trim("name")).alias("name"), "skill").distinct()


def _firsts(known: DataFrame) -> tuple[Broadcast, list[int]]:
    """First words of names (gram) with the lengths of those names, for the tasks; None where there are more than MOST_HEADS. And all lengths."""
    sized = known.where("gram IS NOT NULL").select(F.split("gram", " ").alias("w")).select(F.get("w", F.lit(0)).alias("head"), F.size("w").alias("n")).distinct()
    rows = sized.groupBy("head").agg(F.array_sort(F.collect_list("n")).alias("n")).limit(MOST_HEADS + 1).collect()
    few = len(rows) <= MOST_HEADS
    lengths = {n for r in rows for n in r["n"]} if few else {r[0] for r in sized.select("n").distinct().collect()}
    return known.sparkSession.sparkContext.broadcast({r["head"]: r["n"] for r in rows} if few else None), sorted(lengths) or [1]


def spread(docs: DataFrame, key: str) -> DataFrame:
    """docs in as many tasks as a shuffle has, as adaptive coalescing goes by bytes and would read some ten thousand short texts in one task."""
    # by another expression than the key, as a table that lies by its key already isn't dealt out again
    return docs.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(key))


def _lengths(word: str, lengths: list[int], heads: dict[str, list[int]] | None) -> list[int]:
    """The lengths of names that may begin with a word, with or without its closing dots."""
    if heads is None:
        return lengths
    found = heads.get(word, [])
    bare = heads.get(word.rstrip("."), found) if word.endswith(".") else found
    return found if bare is found or not bare else sorted({*found, *bare})


def named(docs: DataFrame, catalog: DataFrame, aliases: DataFrame, key: str = "candidate_id", text: str = "text") -> DataFrame:
    """(key, name, skill): every name of a catalog skill in the text, by an equi join of its n-grams of the names' lengths.

    Only n-grams that begin as a name does are made, those of grams() otherwise.
    """
    known = names(catalog, aliases)
    heads, lengths = _firsts(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, TEXTS_AT_ONCE):
                part, rows, found = b.slice(i, TEXTS_AT_ONCE), [], []
                for row, low in enumerate(part.column(1).to_pylist()):
                    if low is None:
                        continue
                    words, held = TOKEN.findall(low) or [""], set()
                    for at, word in enumerate(words):
                        for n in _lengths(word, lengths, heads.value):
                            if at + n > len(words):
                                break
                            gram = " ".join(words[at : at + n])
                            held |= {gram, gram.rstrip(".")}
                    rows += [row] * len(held)
                    found += held
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], names=[key, "gram"])

    each = docs.select(key, F.lower(text).alias("text")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, gram string")
    return each.join(known, "gram").select(key, "name", "skill").distinct()


def extract_skills(docs: DataFrame, catalog: DataFrame, aliases: DataFrame, key: str = "candidate_id", text: str = "text") -> DataFrame:
    """(key, skill): every catalog skill that the text names."""
    return named(docs, catalog, aliases, key, text).select(key, "skill").distinct()


def _near(low: str, pattern: re.Pattern[str], spans: list[tuple[str, int, int]]) -> list[bool]:
    """Whether a match of the pattern lies within AROUND characters of each span."""
    found = [m.span() for m in pattern.finditer(low)]
    starts = [s for s, _ in found]
    out = []
    for _, start, end in spans:
        i = bisect_left(starts, start - AROUND)
        out.append(i < len(found) and found[i][1] <= end + AROUND)
    return out


def _gram_spans(low: str, lengths: list[int], heads: dict[str, list[int]] | None) -> list[tuple[str, int, int]]:
    """(gram, start, end) of the runs of tokens that may be a name, with and without a sentence's dots.

    A name stands alone: no letter, digit or one of + # . / - touches it, but for a dot that ends a sentence. Its tokens may be
    parted by white space, line ends, slashes and hyphens.
    """
    tokens = [(m.group(), *m.span()) for m in TOKEN.finditer(low)]
    out = []
    for i, (head, start, _) in enumerate(tokens):
        some = _lengths(head, lengths, heads)
        if not some or start and BEFORE.match(low, start - 1):
            continue
        last = i  # the tokens from i to last are parted by gaps alone
        for n in some:
            if i + n > len(tokens):
                break
            while last < i + n - 1 and GAP.fullmatch(low, tokens[last][2], tokens[last + 1][1]):
                last += 1
            if last < i + n - 1:
                break
            gram, end = " ".join(t for t, _, _ in tokens[i : i + n]), tokens[i + n - 1][2]
            if not AFTER.match(low, end):
                out.append((gram, start, end))
            bare = gram.rstrip(".")
            if bare != gram and not AFTER.match(low, end - len(gram) + len(bare)):
                out.append((bare, start, end - len(gram) + len(bare)))
    return out


def spans(docs: DataFrame, known: DataFrame, phrases: dict[str, str], key: str | list[str] = "candidate_id", text: str = "text") -> DataFrame:
    """(key columns, skill, start, end, and a boolean per phrase): every mention of a name (gram, skill) and which phrases are near it.

    A text is read once, token by token, with the tokens' places; what may be a name goes to an equi join with the names. First
    words of names go to the tasks where they are MOST_HEADS at most; otherwise all runs of words meet the names in the join. Phrases are patterns
    in lower case, of which no match overlaps another.
    """
    named = known.where("gram <> ''").select("gram", "skill").distinct()
    heads, lengths = _firsts(named)
    patterns = {name: re.compile(p) for name, p in phrases.items()}
    keys = [key] if isinstance(key, str) else key

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, TEXTS_AT_ONCE):
                part = b.slice(i, TEXTS_AT_ONCE)
                rows, grams, at, flags = [], [], [], [[] for _ in patterns]
                for row, value in enumerate(part.column(len(keys)).to_pylist()):
                    low = (value or "").lower()
                    found = _gram_spans(low, lengths, heads.value)
                    if not found:
                        continue
                    rows += [row] * len(found)
                    grams += [g for g, _, _ in found]
                    at += [x[1:] for x in found]
                    for flag, pattern in zip(flags, patterns.values()):
                        flag += _near(low, pattern, found)
                take = pa.array(rows, pa.int64())
                columns = [*(part.column(j).take(take) for j in range(len(keys))), pa.array(grams, pa.string()), *(pa.array([x[j] for x in at], pa.int32()) for j in (0, 1)), *(pa.array(f, pa.bool_()) for f in flags)]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "gram", "start", "end", *patterns])

    kinds = [f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*kinds, "gram string", "start int", "`end` int", *(f"`{name}` boolean" for name in phrases)])
    return docs.select(*keys, F.col(text).cast("string").alias("_text")).mapInArrow(run, schema).join(named, "gram").select(*keys, "skill", "start", "end", *phrases)


def partial_skills(docs: DataFrame, catalog: DataFrame, least: float = 0.9, key: str = "candidate_id", text: str = "text") -> DataFrame:
    """(key, skill): skills of two words and more of which some stretch of the normalised text has the ratio `least`.

    Names go to the tasks NAMES_AT_ONCE at a time, with one pass over the texts for each part; a text is compared only around unbroken
    pieces of a name, one of which every such stretch holds.
    """
    many = catalog.select(norm_text("skill").alias("name"), "skill").where("name LIKE '% %'").distinct()
    parts = -(-many.count() // NAMES_AT_ONCE)
    rows = docs.select(key, norm_text(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    found = docs.sparkSession.createDataFrame([], f"`{key}` {kind}, name string")
    for i in range(parts):
        some = [r["name"] for r in many.select("name").distinct().where(F.pmod(F.xxhash64("name"), F.lit(parts)) == i).collect()]
        shared = docs.sparkSession.sparkContext.broadcast(some)

        def run(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            held = Names(shared.value, least)
            for b in batches:
                hits = [(row, n) for row, t in enumerate(b.column(1).to_pylist()) for n in sorted(held.found(t))]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([h[0] for h in hits], pa.int64())), pa.array([h[1] for h in hits], pa.string())], names=[key, "name"])

        part = rows.mapInArrow(run, f"`{key}` {kind}, name string")
        found = found.unionByName(part if parts == 1 else settled(part, "partial"))
    return found.join(many, "name").select(key, "skill").distinct()


def mentions(docs: DataFrame, catalog: DataFrame, aliases: DataFrame, phrases: str, positive: bool, key: str = "candidate_id") -> DataFrame:
    """(key, skill) where some mention has no phrase around it (positive), or has one."""
    found = spans(docs, names(catalog, aliases), {"near": phrases}, key)
    return found.where(~F.col("near") if positive else F.col("near")).select(key, "skill").distinct()


def text_evidence(docs: DataFrame, catalog: DataFrame, aliases: DataFrame, weak: str, hard: str, key: str = "candidate_id") -> DataFrame:
    """(key, skill, hit, weak, hard): of each skill that a text names, whether it is an unstuffed positive mention, and whether
    a weak or hard phrase stands around a mention; the texts are read once."""
    # the texts' variety goes through the one pass over them
    read = spread(docs.select(key, "text"), key).select(key, "text", varied(F.col("text")).alias("varied"))
    found = spans(read, names(catalog, aliases), {"weak": weak, "hard": hard}, [key, "varied"])
    counted = found.groupBy(key, "skill").agg(F.size(F.collect_set("start")).alias("n"), F.max(~F.col("weak")).alias("good"), F.max("weak").alias("weak"), F.max("hard").alias("hard"), F.max("varied").alias("varied"))
    return counted.select(key, "skill", (F.col("varied") & F.col("good") & (F.col("n") <= MOST_MENTIONS)).alias("hit"), "weak", "hard")


def unstuffed_mentions(docs: DataFrame, catalog: DataFrame, aliases: DataFrame, phrases: str, key: str = "candidate_id") -> DataFrame:
    """(key, skill) with a positive mention, MOST_MENTIONS mentions at most, in a text of varied words."""
    return text_evidence(docs, catalog, aliases, phrases, phrases, key).where("hit").select(key, "skill")


def varied(text: Column) -> Column:
    """Whether a text's different words are at least 35 % of its words."""
    words = F.array_remove(F.split(F.translate(F.lower(text), "/,", "  "), "\\s+"), "")
    return F.coalesce(F.size(F.array_distinct(words)) / F.size(words) >= 0.35, F.lit(False))


def section(text: Column, header: str, headers: str) -> Column:
    """The lines after a header up to the next header."""
    return F.regexp_extract(text, f"(?s)(?:^|\\n){header}\\n(.*?)(?:\\n(?:{headers})\\n|$)", 1)


HEADERS = "Skills|Experience|Education|Projects|Languages|Summary"


def project_skills(cvs: DataFrame, catalog: DataFrame, aliases: DataFrame) -> DataFrame:
    """(candidate_id, skill) named in the projects of a CV."""
    return extract_skills(cvs.select("candidate_id", section(F.col("text"), "Projects", HEADERS).alias("text")), catalog, aliases)


def project_bonus(jobs: DataFrame, job_skills: DataFrame, cvs: DataFrame, catalog: DataFrame, aliases: DataFrame) -> DataFrame:
    """(job_id, candidate_id, bonus): 0.5 for junior jobs with a skill in the candidate's projects."""
    from ..plans.match_all import for_every_job
    from .matching import is_junior

    junior = jobs.where(is_junior(F.col("title"), F.col("seniority")))
    shown = settled(project_skills(cvs, catalog, aliases), "projects").repartition(int(jobs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "candidate_id")
    need = job_skills.join(junior.select("job_id"), "job_id", "left_semi")
    return for_every_job(junior, need, lambda first: first.join(shown, "skill").select("job_id", "candidate_id", F.lit(0.5).alias("bonus")).distinct())


def _signals(text: Column) -> tuple[Column, Column]:
    """Whether a text tells of an internship, and of a certificate."""
    return text.rlike(r"(?i)\b(?:intern|internship|trainee)\b"), text.rlike(r"(?i)\b(?:certificate|certification|certified)\b")


def year_credit(text: Column) -> Column:
    """Years that a junior job credits for internships and certificates, 1 at most."""
    intern, certificate = _signals(text)
    return F.least(F.lit(1.0), F.when(intern, 0.5).otherwise(0.0) + F.when(certificate, 0.25).otherwise(0.0))


def junior_credit(pairs: DataFrame) -> DataFrame:
    """(job_id, candidate_id, credit, signals) for pairs of a junior job and a CV text: internships and certificates."""
    intern, certificate = _signals(F.col("text"))
    signals = F.array_compact(F.array(F.when(intern, F.lit("internship_experience")), F.when(certificate, F.lit("relevant_certificate"))))
    return pairs.select("job_id", "candidate_id", year_credit(F.col("text")).alias("credit"), F.array_join(signals, ",").alias("signals"))
