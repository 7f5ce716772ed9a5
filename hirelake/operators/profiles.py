"""CV and job texts to structured profiles, with native expressions."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import in_order, norm_name, norm_text
from ..sources.tables import settled
from .text import AROUND, TEXTS_AT_ONCE, extract_skills, names, spans, spread

#: How a section's header begins, in the order of trial; spoken languages, degrees by rank, phrases by status.
SECTIONS = {
    "experience": "experience|work history|employment|professional experience|work experience",
    "education": "education|academic|qualifications|degree",
    "projects": "projects|project experience|personal projects",
    "skills": "skills|technical skills|core competencies|technologies",
    "summary": "summary|objective|profile|about me|professional summary",
    "languages": "languages|language proficiency",
    "other": "certifications|certificates|awards|publications|references|contact",
}
SPOKEN = ["arabic", "chinese", "dutch", "english", "french", "german", "italian", "portuguese", "russian", "spanish"]
LANGUAGE_WORDS = ["english", "french", "spanish", "german", "italian", "portuguese", "turkish", "russian", "mandarin", "chinese"]
DEGREE_WORDS = ["bachelor", "master", "phd", "doctorate", "degree", "bsc", "msc", "ba", "ma", "mba", "diploma"]
DEGREE_RANKS = [
    ("phd", 7), ("doctorate", 7), ("doctoral", 7), ("mba", 6), ("master", 5), ("msc", 5), ("ma", 5), ("bachelor", 4), ("bsc", 4), ("ba", 4),
    ("diploma", 3), ("associate", 2), ("certificate", 1),
]
STOP_WORDS = ["built", "candidate", "education", "experience", "professional", "projects", "skills", "summary", "technologies", "tools", "using", "workflows"]
SKILL_HEADERS = ["skills", "technologies", "tools"]
DEGREES = [("phd|doctorate", 7), ("mba", 6), ("master", 5), ("bachelor", 4), ("diploma", 3), ("associate", 2), ("certificate", 1)]
STATUS_PHRASES = [
    "don't know", "do not know", "no experience", "not experienced", "never used", "haven't used", "not familiar",
    "don't have", "do not have", "no knowledge", "currently learning", "want to learn", "wish to learn",
]
PHRASE_REACH = 100
NON_SKILLS = ["project", "projects", "project experience", "personal projects"]
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?\d[\d\s().-]{8,}\d"
YEARS = r"\b((?:19|20)\d{2})\s*(?:-|–|to)\s*((?:19|20)\d{2}|present|current|now)\b"


def text(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def parseable(c: str = "text") -> Column:
    return F.length(F.regexp_replace(text(c), "[^\\p{L}\\p{N}]", "")) >= 10


def line_array(c: str | Column = "text") -> Column:
    """Trimmed lines that aren't empty."""
    return F.filter(F.transform(F.split(text(c), "\\R"), lambda s: F.trim(s)), lambda s: s != "")


def header_of(line: Column) -> Column:
    """The section that a line is the header of; null for other lines. `Technologies: ...` is no header."""
    header = F.lit(None).cast("string")
    for name, pattern in reversed(SECTIONS.items()):
        hit = line.rlike(f"(?i)^(?:{pattern})\\b")
        header = F.when(hit & ~line.rlike("(?i)^technologies\\s*:\\s*\\S") if name == "skills" else hit, name).otherwise(header)
    return header


def with_sections(df: DataFrame) -> DataFrame:
    """df with _lines and _sections (section, from, n): what lies between two headers, by positions alone, so that no row is shuffled."""
    heads = F.filter(F.transform("_lines", lambda s, i: F.struct(i.alias("at"), header_of(s).alias("section"))), lambda h: h["section"].isNotNull())
    upto = F.transform("_heads", lambda h, j: F.struct(h["section"].alias("section"), (h["at"] + 2).alias("from"), (F.coalesce(F.get("_heads", j + 1)["at"], F.size("_lines")) - h["at"] - 1).alias("n")))
    return df.withColumn("_lines", line_array()).withColumn("_heads", heads).withColumn("_sections", upto).drop("_heads")


def section_lines(name: str) -> Column:
    """Of a row with sections: the lines of all sections of that name."""
    of_name = F.filter("_sections", lambda h: h["section"] == name)
    return F.flatten(F.transform(of_name, lambda h: F.slice("_lines", h["from"], h["n"])))


def split_sections(df: DataFrame, key: str = "candidate_id") -> DataFrame:
    """(key, section, pos, line): lines below the last header; those before the first header, and of other sections, are dropped."""
    rows = with_sections(df.select(key, "text")).select(key, "_lines", F.explode("_sections").alias("s")).where("s.section <> 'other'")
    return rows.select(key, "s.section", F.col("s.from").alias("start"), F.posexplode(F.slice("_lines", F.col("s.from"), F.col("s.n"))).alias("pos", "line")).withColumn("pos", F.col("start") + F.col("pos")).drop("start")


def section_text(df: DataFrame, name: str, key: str = "candidate_id") -> DataFrame:
    return split_sections(df, key).where(F.col("section") == name).groupBy(key).agg(in_order("line", "pos", sep="\n").alias("text"))


def extract_contacts(df: DataFrame) -> DataFrame:
    """df with the first e-mail, the first phone and the location line; null where there is none."""
    none = lambda c: F.when(c != "", c)
    phone = F.trim(F.regexp_extract("text", PHONE, 0))
    place = F.substring(F.trim(F.regexp_extract("text", "(?im)^(?:location|address)\\s*[:\\-]\\s*([^\\n]+)$", 1)), 1, 120)
    return df.withColumns({"email": none(F.lower(F.regexp_extract("text", EMAIL, 0))), "phone": none(phone), "location": none(place)})


def extract_name(c: str = "text") -> Column:
    """The first line if it is short and holds no contact, else the first line of capitalised words of ten."""
    rows = F.filter(F.transform(F.split(text(c), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    first = F.try_element_at(rows, F.lit(1))
    plain = (F.size(F.split(first, "\\s+")) <= 5) & (F.length(first) <= 60) & ~first.rlike(EMAIL) & ~first.rlike(PHONE)
    titled = F.try_element_at(F.filter(F.slice(rows, 1, 10), lambda s: s.rlike(r"^(?:\p{Lu}[\p{L}'-]+\s+){1,3}\p{Lu}[\p{L}'-]+$")), F.lit(1))
    return F.when(plain, first).otherwise(titled)


def spoken_languages(c: Column) -> Column:
    low = F.lower(c)
    return F.filter(F.array(*[F.lit(x) for x in SPOKEN]), lambda x: F.regexp_like(low, F.concat(F.lit("\\b"), x, F.lit("\\b"))))


def sentences(df: DataFrame, key: str = "candidate_id") -> DataFrame:
    """(key, pos, sentence): pieces between . ! ? and line ends, the first of those equal but for case and spaces."""
    first = Window.partitionBy(key, norm_name("sentence")).orderBy("pos")
    return pieces(df, key).withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def pieces(df: DataFrame, key: str = "candidate_id") -> DataFrame:
    """As sentences, with the repeated ones."""
    cut = df.select(key, F.posexplode(F.split(text("text"), "[!?\\n]|\\.(?=\\s|$)")).alias("pos", "sentence"))
    return cut.withColumn("sentence", F.trim("sentence")).where("sentence <> ''")


def skill_mentions(rows: DataFrame, known: DataFrame, key: str = "candidate_id") -> DataFrame:
    """(key, pos, skill, status, level, years, confidence, context) of the skills named in each sentence (key, pos, sentence).

    The first phrase of the list whose place is within PHRASE_REACH characters of the skill's decides; known (gram, skill) are names. Of
    sentences that are equal but for case and spaces only the first counts: they name the same skills, so only those that name any are compared.
    """
    named = spans(rows, known, {}, [key, "pos", "sentence"], "sentence")
    found = named.groupBy(key, norm_name("sentence").alias("_same"), "skill").agg(F.min(F.struct("pos", "start", "sentence")).alias("m")).select(key, "skill", "m.*")
    low = F.replace(F.lower("sentence"), F.lit("\u2019"), F.lit("'"))
    at = lambda p: F.instr(low, p) - 1
    phrase = F.try_element_at(F.filter(F.array(*[F.lit(p) for p in STATUS_PHRASES]), lambda p: (at(p) >= 0) & (F.abs(at(p) - F.col("start")) < PHRASE_REACH)), F.lit(1))
    years = F.regexp_extract(low, "(\\d+(?:\\.\\d+)?)\\s*(?:year|yr)", 1)
    n = F.when(phrase.isNull() & (years != ""), years.cast("double"))
    status = F.when(phrase.contains("learn"), "learning").when(phrase.isNotNull(), "no_experience").otherwise("has_experience")
    level = F.when(n >= 5, "senior").when(n >= 2, "mid").when(n.isNotNull(), "junior")
    confidence = F.when(phrase.isNotNull(), 0.85).when(n.isNotNull(), 0.75).otherwise(0.6)
    return found.select(key, "pos", "skill", status.alias("status"), level.alias("level"), n.alias("years"), confidence.alias("confidence"), F.col("sentence").alias("context"))


def best_skill_detail(found: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Per skill the mention of the best status, the earliest of equals."""
    rank = F.when(F.col("status") == "has_experience", 0).when(F.col("status") == "learning", 1).when(F.col("status") == "no_experience", 2).otherwise(3)
    return found.groupBy(key, "skill").agg(F.min_by(F.struct("status", "level", "years", "confidence", "context"), F.struct(rank.alias("r"), F.col("pos"))).alias("m")).select(key, "skill", "m.*")


def merge_skill_details(primary: DataFrame, fallback: DataFrame, key: str = "candidate_id") -> DataFrame:
    """Per skill the higher of has_experience, unknown, learning, no_experience; the primary set's of equals."""
    rank = F.when(F.col("status") == "has_experience", 0).when(F.col("status") == "unknown", 1).when(F.col("status") == "learning", 2).otherwise(3)
    both = primary.select(key, "skill", "status", F.lit(0).alias("source")).unionByName(fallback.select(key, "skill", "status", F.lit(1).alias("source")))
    return both.groupBy(key, "skill").agg(F.min_by(F.struct("status", "source"), F.struct(rank.alias("r"), F.col("source"))).alias("m")).select(key, "skill", "m.status", "m.source")


def experience_entries(df: DataFrame, as_of_year: int, key: str = "candidate_id") -> DataFrame:
    """(key, entry, title, company, start_year, end_year, description): a dated line opens an entry, bullets describe it."""
    rows = split_sections(df, key).where("section = 'experience'")
    opens = F.col("line").rlike(YEARS) | (F.col("line").rlike(r"^\p{Lu}[\w\s]* (?:at|in|with|for) \p{Lu}") & ~F.col("line").startswith("-"))
    upto = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("entry", F.greatest(F.lit(1), F.sum(opens.cast("int")).over(upto))).withColumn("opens", opens)
    head = F.max(F.when(F.col("opens"), F.col("line")))
    grouped = numbered.withColumn("told", F.when(~F.col("opens"), F.regexp_replace("line", "^[-•*]\\s*", ""))).groupBy(key, "entry").agg(head.alias("head"), in_order("told", "pos", sep=" ").alias("description"))
    bare = F.trim(F.regexp_replace("head", YEARS, ""))
    last = F.lower(F.regexp_extract("head", YEARS, 2))
    year = lambda c: F.when(c != "", F.when(c.rlike("^\\d+$"), c.try_cast("int")).otherwise(as_of_year))
    none = lambda c: F.when(c != "", c)
    return grouped.select(
        key,
        "entry",
        F.coalesce(none(F.regexp_extract(bare, "^(.*?) (?:at|-) ", 1)), bare).alias("title"),
        none(F.trim(F.regexp_extract(bare, " (?:at|-) (.*)$", 1))).alias("company"),
        year(F.regexp_extract("head", YEARS, 1)).alias("start_year"),
        year(last).alias("end_year"),
        "description",
    )


def education_entries(df: DataFrame, key: str = "candidate_id") -> DataFrame:
    """(key, pos, degree, rank, institution, year) of the lines of the education section that name a degree."""
    rank = F.lit(None).cast("int")
    for pattern, value in reversed(DEGREES):
        rank = F.when(F.col("line").rlike(f"(?i)\\b(?:{pattern})"), value).otherwise(rank)
    rows = split_sections(df, key).where("section = 'education'").withColumn("rank", rank).where("rank IS NOT NULL")
    none = lambda c: F.when(c != "", c)
    where = none(F.trim(F.regexp_extract("line", r"(?i)([\w ]*(?:university|college|institute|school)[\w ]*?)(?:\s+\d{4})?$", 1)))
    return rows.select(key, "pos", F.trim(F.regexp_extract("line", "^([^,]*)", 1)).alias("degree"), "rank", where.alias("institution"), none(F.regexp_extract("line", "\\b((?:19|20)\\d{2})\\b", 1)).try_cast("int").alias("year"))


def highest_degree(entries: DataFrame, key: str = "candidate_id") -> DataFrame:
    return entries.groupBy(key).agg(F.max_by("degree", F.struct(F.col("rank"), -F.col("pos"))).alias("highest_degree"))


def total_years(entries: DataFrame, key: str = "candidate_id") -> DataFrame:
    """The sum of the entries' spans, within 0 and 60."""
    span = F.when(F.col("start_year").isNotNull() & F.col("end_year").isNotNull(), F.col("end_year") - F.col("start_year"))
    return entries.groupBy(key).agg(F.least(F.lit(60.0), F.greatest(F.lit(0.0), F.sum(span).cast("double"))).alias("total_years"))


def legacy_years(c: Column) -> Column:
    """Of a text: the largest year less the smallest, 0 below two years."""
    found = F.transform(F.regexp_extract_all(c, F.lit("\\b((?:19|20)\\d{2})\\b"), F.lit(1)), lambda y: y.cast("int"))
    return F.when(F.size(found) >= 2, F.array_max(found) - F.array_min(found)).otherwise(0)


def job_title(c: str = "text") -> Column:
    rows = F.filter(F.transform(F.split(text(c), "\n"), lambda s: F.trim(s)), lambda s: s != "")
    return F.substring(F.try_element_at(rows, F.lit(1)), 1, 120)


REQUIRED, OPTIONAL = "(?:requirements|required skills|must have|qualifications)", "(?:nice to have|optional skills|preferred|bonus)"


def job_section(c: str, which: str) -> Column:
    """The text from a header, the rest of its line included, to a blank line or another header."""
    header = REQUIRED if which == "required" else OPTIONAL
    return F.regexp_extract(text(c), f"(?is)(?:^|\\n){header}\\s*:?[ \\t]*(.*?)(?:\\n\\s*\\n|\\n{REQUIRED}|\\n{OPTIONAL}|$)", 1)


def bonus_lines(c: str = "text") -> Column:
    return F.array_join(F.filter(F.split(text(c), "\n"), lambda s: s.rlike("(?i)is a plus|nice to have|is a bonus|preferred")), "\n")


def job_seniority(c: str = "text") -> Column:
    return F.when(F.col(c).rlike("(?i)\\b(?:junior|entry[- ]level|graduate|intern)\\b"), "junior").when(F.col(c).rlike("(?i)\\b(?:mid|intermediate)\\b"), "mid").when(F.col(c).rlike("(?i)\\b(?:senior|lead|principal|staff)\\b"), "senior")


def content_tokens(c: Column, stopwords: list[str]) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z][a-z0-9+#.-]{2,}"), F.lit(0))), F.array(*[F.lit(w) for w in stopwords]))


def snippet(c: Column, needle: Column, radius: int = 120) -> Column:
    at = F.instr(F.lower(c), F.lower(needle))
    start = F.greatest(F.lit(1), at - radius)
    return F.when(at > 0, F.trim(F.regexp_replace(F.substr(c, start, at - start + F.length(needle) + radius), "\\s+", " ")))


def topical_filter(df: DataFrame, keywords: list[str], k: int = 2, least: int = 200) -> DataFrame:
    low = F.lower(text("text"))
    return df.where((F.length("text") >= least) & (F.size(F.filter(F.array(*[F.lit(w) for w in keywords]), lambda w: low.contains(w))) >= k))


TERM = re.compile(r"\b[A-Za-z][A-Za-z0-9+#.-]{2,}(?:\s+[A-Za-z][A-Za-z0-9+#.-]{2,}){0,2}\b", re.ASCII)


def _terms(docs: DataFrame, key: str) -> DataFrame:
    """(key, pos, term, before): runs of one to three words, and the AROUND characters before each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, TEXTS_AT_ONCE):
                part = b.slice(i, TEXTS_AT_ONCE)
                found = [(row, m.start(), m.group(), t[max(0, m.start() - AROUND) : m.start()]) for row, t in enumerate(part.column(1).to_pylist()) for m in TERM.finditer(t or "")]
                columns = [pa.array([f[j] for f in found], kind) for j, kind in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(0).take(columns[0]), *columns[1:]], names=[key, "pos", "term", "before"])

    return docs.select(key, text("text").alias("text")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, pos int, term string, before string")


def uncatalogued_skills(df: DataFrame, known: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """(key, skill): the first `limit` different runs of one to three words that no skill is known by.

    A run looks technical (an inner capital or one of + # . -) or stands within AROUND characters of a skills header, and holds no stop word.
    """
    term, lit = F.regexp_replace("term", "\\s+", " "), lambda names: F.array(*[F.lit(n) for n in names])
    shaped = F.substring("term", 2, 1 << 20).rlike("\\p{Lu}") | F.col("term").rlike("[+#.-]") | F.exists(lit(SKILL_HEADERS), lambda h: F.lower("before").contains(h))
    each = _terms(df, key).where(shaped).select(key, "pos", F.substring(norm_name(term), 1, 120).alias("skill"))
    each = each.where(~F.arrays_overlap(F.split("skill", " "), lit(STOP_WORDS))).join(known.select(norm_name("skill").alias("skill")).distinct(), "skill", "left_anti")
    first = each.groupBy(key, "skill").agg(F.min("pos").alias("pos"))
    return first.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy("pos"))).where(F.col("rn") <= limit).select(key, "skill")


def _starts(rows: str, opens: Callable[[Column], Column]) -> Column:
    """-1 and the places of the lines that open a segment."""
    return F.concat(F.array(F.lit(-1)), F.filter(F.transform(rows, lambda s, i: F.when(opens(s), i)), lambda i: i.isNotNull()))


def _segments(rows: str, starts: str) -> Column:
    """An array of lines as (head, body): one per line that opens, and what stands before the first (head null).

    Here and below what a function of elements needs of the whole row is a column of its own: in the function it would be worked out for each element.
    """

    def cut(i: Column, j: Column) -> Column:
        end = F.coalesce(F.get(starts, j + 1), F.size(rows))
        return F.struct(F.when(i >= 0, F.get(rows, i)).alias("head"), F.slice(rows, i + 2, end - i - 1).alias("body"))

    return F.transform(starts, cut)


def _from_bullet(body: Column) -> Column:
    """The lines from the first bullet on."""
    at = F.array_position(F.transform(body, lambda s: F.substring(s, 1, 1).isin("-", "•", "*", "◦")), F.lit(True)).cast("int")
    return F.when(at > 0, F.slice(body, at, F.size(body))).otherwise(F.array().cast("array<string>"))


def _none(c: Column) -> Column:
    return F.when(c != "", c)


AT, DASH = r"^(.+?)\s+at\s+(.+?)(?:\s*[-–|]\s*.*)?$", r"^(.+?)\s*[-–|]\s*(.+?)(?:\s*[-–|]\s*.*)?$"


def _experience(segments: str, stray: str, as_of_year: int) -> Column:
    """Entries (title, company, start_year, end_year, description) of segments; what bullets stand before the first entry (stray) describe it."""
    opened = F.transform(F.slice(segments, 2, F.greatest(F.size(segments), F.lit(1))), lambda s: F.struct(s["head"].alias("head"), s["body"].alias("body"), F.trim(F.regexp_replace(s["head"], YEARS, "")).alias("bare"), F.lower(F.regexp_extract(s["head"], YEARS, 2)).alias("last")))
    part = lambda s, pattern, n: F.trim(F.regexp_extract(s["bare"], pattern, n))
    told = F.transform(opened, lambda s: F.struct(s.alias("s"), part(s, AT, 1).alias("at1"), part(s, AT, 2).alias("at2"), part(s, DASH, 1).alias("dash1"), part(s, DASH, 2).alias("dash2"), F.regexp_extract(s["head"], YEARS, 1).alias("first"), _from_bullet(s["body"]).alias("told")))

    def entry(t: Column, j: Column) -> Column:
        s = t["s"]
        lines = F.when((j == 0) & (F.size(stray) > 0), F.concat(stray, s["body"])).otherwise(t["told"])
        return F.struct(
            F.coalesce(_none(t["at1"]), _none(t["dash1"]), s["bare"]).alias("title"),
            F.coalesce(_none(t["at2"]), _none(t["dash2"])).alias("company"),
            t["first"].try_cast("int").alias("start_year"),
            F.when(s["last"] != "", F.coalesce(s["last"].try_cast("int"), F.lit(as_of_year))).alias("end_year"),
            _none(F.array_join(lines, "\n")).alias("description"),
        )

    return F.transform(told, entry)


def _education(segments: str) -> Column:
    """Entries (degree, institution, end_year, gpa, description): a line that names a degree opens one; what stands before makes one of its own."""
    some = F.filter(segments, lambda s: s["head"].isNotNull() | (F.size(s["body"]) > 0))
    graded = lambda x: F.lower(x).contains("gpa")
    rest = F.transform(some, lambda s: F.struct(s["head"].alias("head"), F.filter(s["body"], lambda x: ~graded(x)).alias("rest"), F.filter(s["body"], graded).alias("gpa")))
    dated = F.transform(rest, lambda s: F.struct(s.alias("s"), F.array_position(F.transform(s["rest"], lambda x: x.rlike("(?:19|20)\\d{2}")), F.lit(True)).cast("int").alias("at")))
    other = F.transform(dated, lambda d: F.struct(d["s"].alias("s"), F.get(d["s"]["rest"], d["at"] - 1).alias("year"), F.filter(d["s"]["rest"], lambda x, i: i + 1 != d["at"]).alias("other")))
    return F.transform(
        other,
        lambda o: F.struct(
            o["s"]["head"].alias("degree"), F.get(o["other"], F.lit(0)).alias("institution"), F.regexp_extract(o["year"], "((?:19|20)\\d{2})", 1).try_cast("int").alias("end_year"),
            F.get(o["s"]["gpa"], F.size(o["s"]["gpa"]) - 1).alias("gpa"), F.get(o["other"], F.lit(1)).alias("description"),
        ),
    )


def _highest(entries: str) -> Column:
    """The first degree of the highest rank; a degree counts by the first word of the list that raises the rank."""

    def better(best: Column, e: Column) -> Column:
        out = best
        for word, rank in reversed(DEGREE_RANKS):
            out = F.when(F.lower(e["degree"]).contains(word) & (best["rank"] < rank), F.struct(e["degree"].alias("degree"), F.lit(rank).alias("rank"))).otherwise(out)
        return out

    return F.aggregate(entries, F.struct(F.lit(None).cast("string").alias("degree"), F.lit(-1).alias("rank")), better)["degree"]


def full_profiles(df: DataFrame, as_of_year: int, key: str = "candidate_id") -> DataFrame:
    """One row per text (key, text), by expressions over its lines, so that nothing is shuffled and a stream may hold it.

    full_name, email, phone, location, languages, experience (lines), experience_entries, total_years, education, education_entries,
    highest_degree, projects, summary, status. A text of fewer than ten letters and digits has failed, and all else null or empty.
    """
    opens = lambda s: s.rlike(YEARS) | s.rlike("^[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)*\\s+(?:at|in|with|for)\\s+")
    degree = lambda s: F.lower(s).rlike("|".join(DEGREE_WORDS))
    ok = parseable("text")
    rows = with_sections(df.select(key, F.when(ok, F.col("text")).alias("text"), F.when(ok, "completed").otherwise("failed").alias("status")))
    rows = extract_contacts(rows).withColumns({name: section_lines(name) for name in SECTIONS if name != "other"}).withColumn("full_name", extract_name("text"))
    spoken = norm_text(F.when(F.size("languages") > 0, F.array_join("languages", " ")).otherwise(text("text")))
    rows = rows.withColumns({"_spoken": spoken, "_jobs_at": _starts("experience", opens), "_schools_at": _starts("education", degree)})
    rows = rows.withColumns({"_jobs": _segments("experience", "_jobs_at"), "_schools": _segments("education", "_schools_at")})
    rows = rows.withColumn("_stray", _from_bullet(F.get("_jobs", F.lit(0))["body"]))
    rows = rows.withColumns({"experience_entries": _experience("_jobs", "_stray", as_of_year), "education_entries": _education("_schools")})
    span = F.aggregate("experience_entries", F.lit(None).cast("double"), lambda a, e: F.coalesce(F.coalesce(a, F.lit(0.0)) + (e["end_year"] - e["start_year"]), a))
    stated = F.regexp_extract(text("text"), r"(?i)Total Years of Experience:\s*([\d.]+)", 1).try_cast("double")
    return rows.select(
        key, "status", "full_name", "email", "phone", "location", F.array_compact(F.array(*[F.when(F.col("_spoken").rlike(rf"\b{w}\b"), w) for w in sorted(LANGUAGE_WORDS)])).alias("languages"),
        "experience", "experience_entries", F.coalesce(span, stated).alias("total_years"), "education", "education_entries", _highest("education_entries").alias("highest_degree"), "projects",
        _none(F.array_join("summary", "\n")).alias("summary"),
    )


def profiles_with_skills(df: DataFrame, catalog: DataFrame, aliases: DataFrame, as_of_year: int, key: str = "candidate_id") -> DataFrame:
    """full_profiles with skills_detailed (skill, status, level, years, confidence, context), skills, negative_skills, learning_skills and
    uncatalogued_skills, all sorted by name."""
    df = settled(spread(df.select(key, "text"), key), "texts")
    ok = df.where(parseable("text"))
    known = names(catalog, aliases)
    told = skill_mentions(pieces(ok, key), known, key)
    # named in the text but in none of its sentences, as across a line's end
    none = {"pos": F.lit(1 << 30), "status": F.lit("unknown"), "level": F.lit(None).cast("string"), "years": F.lit(None).cast("double"), "confidence": F.lit(0.5), "context": F.lit(None).cast("string")}
    details = best_skill_detail(told.unionByName(extract_skills(ok, catalog, aliases, key).withColumns(none)), key)
    other = uncatalogued_skills(ok, known.select(F.explode(F.array("name", "gram")).alias("skill")), key)
    rows = details.select(key, F.struct("skill", "status", "level", "years", "confidence", "context").alias("d"), F.lit(None).cast("string").alias("u"))
    rows = rows.unionByName(other.select(key, F.lit(None).cast(rows.schema["d"].dataType).alias("d"), F.col("skill").alias("u")))
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list("d")).alias("d"), F.array_sort(F.collect_list("u")).alias("uncatalogued_skills"))

    def of(*status: str) -> Column:
        return F.transform(F.filter("d", lambda x: x["status"].isin(*status)), lambda x: x["skill"])

    columns = {"skills": of("has_experience", "learning", "unknown"), "negative_skills": of("no_experience"), "learning_skills": of("learning")}
    listed = listed.select(key, F.col("d").alias("skills_detailed"), *[c.alias(n) for n, c in columns.items()], "uncatalogued_skills")
    joined = full_profiles(df, as_of_year, key).join(listed, key, "left")
    return joined.withColumns({c: F.coalesce(c, F.array().cast(listed.schema[c].dataType)) for c in listed.columns if c != key})


def parse_cvs(df: DataFrame, as_of_year: int = 2024) -> DataFrame:
    """One row per text, by expressions only, so that it also runs on a stream: contacts, name, languages, years, degree, status."""
    with_contacts = extract_contacts(df)
    spans = F.transform(
        F.regexp_extract_all(text("text"), F.lit(YEARS), F.lit(0)),
        lambda s: F.coalesce(F.regexp_extract(s, YEARS, 2).try_cast("int"), F.lit(as_of_year)) - F.regexp_extract(s, YEARS, 1).cast("int"),
    )
    years = F.least(F.lit(60), F.greatest(F.lit(0), F.aggregate(spans, F.lit(0), lambda a, b: a + b))).cast("double")
    degree = F.lit(None).cast("string")
    for pattern, _ in reversed(DEGREES):
        degree = F.when(F.col("text").rlike(f"(?i)\\b(?:{pattern})"), pattern.split("|")[0]).otherwise(degree)
    ok = parseable("text")
    return with_contacts.withColumns(
        {"full_name": extract_name("text"), "languages": F.array_join(spoken_languages(text("text")), ","), "total_years": years, "degree": degree, "status": F.when(ok, "completed").otherwise("failed")}
    ).drop("text")


def backfill_years(cands: DataFrame, cvs: DataFrame) -> DataFrame:
    """cands with years: where unknown, what the CV's text (candidate_id, text) gives; known ones kept within 0 and 60."""
    found = parse_cvs(cvs.join(cands.where("years IS NULL").select("candidate_id"), "candidate_id", "left_semi")).select("candidate_id", F.col("total_years").alias("parsed"))
    years = F.least(F.lit(60.0), F.greatest(F.lit(0.0), F.coalesce("years", "parsed")))
    return cands.join(found, "candidate_id", "left").withColumn("years", years).drop("parsed")
