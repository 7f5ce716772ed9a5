"""Operators 11 to 13 against brute-force versions, and their defined results in odd cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.llm import divergence, fingerprints, resampling
from tests.conftest import SF

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (4, "One two"), (None, "one TWO"), (5, "x" * 200_000), (6, "a b c d e f " * 3000), (7, "été ÉTÉ 12 x-y\x7fz")]


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# --- 11: resampling -------------------------------------------------------------------------------------------------


def plain_resample(rows, target, percent=25, least_words=20, buckets=10_000):
    def found(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
        return w, [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]

    s = collections.Counter(b for _, t in rows for b in found(t)[1])
    t = collections.Counter(b for x in target for b in found(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in rows:
        w, f = found(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{doc_id if doc_id is not None else chr(92) + 'N'}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least_words])
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0], -r[1]))
    rank = {id(r): i + 1 for i, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((r[0], r[1], r[2], r[3], rank.get(id(r))) for r in out), key=str)


def resampled(found):
    return sorted((tuple(r) for r in found.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_resampling_equals_plain(spark):
    rows = [(r.doc_id, r.text) for r in docs(spark).select("doc_id", "text").collect()]
    target = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert resampled(resampling.resample(docs(spark), target)) == plain_resample(rows, [r.text for r in target.collect()])


def test_resampling_of_odd_rows(spark):
    rows = ODD + [(8, "one two " * 15)] * 4 + [(None, "three four " * 15)] * 2
    frame = spark.createDataFrame(rows, DOCS).withColumn("rank", F.lit("x")).withColumn("k0", F.lit("x")).repartition(3)
    target = spark.createDataFrame([("one two",), (None,), ("",)], "text string")
    found = resampling.resample(frame, target, percent=50)
    assert resampled(found) == plain_resample(rows, ["one two"], percent=50)
    drawn = resampling.resampled(spark.createDataFrame([r for r in rows if r[0] in (1, 5, 6)] + [(9, "one two " * 20)], DOCS), target, percent=50).collect()
    assert len(drawn) == 1 and drawn[0].rank == 1 and drawn[0].text


def test_resampling_of_nothing(spark):
    none, some = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a b " * 20)], DOCS)
    assert resampling.resample(none, some).count() == 0
    assert [r.rank for r in resampling.resample(some, none, percent=100).collect()] == [1]
    assert [r.rank for r in resampling.resample(some, none).collect()] == [None]


@pytest.mark.parametrize("k", [1, 2, 700, 1500, 2999, 3000])
def test_cutoff_is_the_kth_key(spark, monkeypatch, k):
    monkeypatch.setattr(resampling, "CHUNK_KEYS", 100)
    rng = random.Random(5)
    keys = [(rng.randrange(-5, 5) if i % 3 else 0, rng.randrange(4), 0, i) for i in range(3000)]
    frame = spark.createDataFrame(keys, "k0 long, k1 long, k2 long, k3 long").repartition(5)
    assert resampling.cutoff(frame, k) == sorted(keys)[k - 1]


def test_cutoff_of_too_few(spark):
    frame = spark.createDataFrame([(1, 2, 3, 4)], "k0 long, k1 long, k2 long, k3 long")
    assert resampling.cutoff(frame, 0) is None and resampling.cutoff(frame, 2) is None and resampling.cutoff(frame.where("false"), 1) is None


def test_runs_of_three_words_have_their_texts_crc():
    w = resampling.words_of("Ab, 1é".encode() + b" c\x7fd")
    assert w == [b"ab", "1é".encode(), b"c", b"d"]
    runs = [b" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]
    assert resampling.feature_buckets(w, 3, 1009).tolist() == [zlib.crc32(r) % 1009 for r in runs]


# --- 12: fingerprints -----------------------------------------------------------------------------------------------


def as_text(t):
    return fingerprints.as_string(fingerprints.of_text(t))


def test_paragraphs_in_any_order_inserted_and_deleted(spark):
    lines = ["Some words of a first line", "", "another line, of other words here", "Some words of a first line", "x"]
    shuffled = random.Random(1).sample(lines, len(lines))
    assert as_text("\n".join(lines)) == as_text("\n".join(shuffled))
    different = ["\n".join(lines[1:]), "\n".join([*lines, ""]), "\n".join(lines).lower(), " ".join(lines), "", None]
    assert len({as_text(t) for t in different}) == len(different) - 1  # null is empty
    edits = spark.createDataFrame(
        [(1, as_text("\n".join(lines)), [lines[0], "x"], ["new one"]), (2, as_text("a"), None, None), (3, None, None, ["a", None]), (None, as_text("a"), ["a"], ["b"])],
        "doc_id long, fingerprint string, deleted array<string>, inserted array<string>",
    )
    found = {r.doc_id: r.fingerprint for r in fingerprints.updated(edits).collect()}
    assert found == {1: as_text("\n".join([*lines[1:4], "new one"])), 2: as_text("a"), 3: as_text("a\n"), None: as_text("b")}


def test_fingerprint_of_a_table_is_that_of_its_paragraphs(spark):
    rows = [r.text for r in docs(spark).select("text").collect()]
    assert fingerprints.collection_fingerprint(docs(spark)) == as_text("\n".join(rows))
    assert fingerprints.collection_fingerprint(docs(spark).where("false")) == fingerprints.as_string(fingerprints.vector([]))
    assert {r.fingerprint for r in fingerprints.fingerprints(docs(spark)).collect()} == {as_text(t) for t in rows}


def test_likeness_tells_the_share_of_common_shingles():
    rng = random.Random(3)

    def line():
        return " ".join(f"w{rng.randrange(5000)}" for _ in range(30))

    errors = []
    for common in range(0, 41, 4):
        both = [line() for _ in range(common)]
        x, y = ("\n".join(both + [line() for _ in range(40 - common)]) for _ in range(2))
        errors.append(fingerprints.likeness(fingerprints.of_text(x), fingerprints.of_text(y)) - common / 40)
    assert np.abs(errors).max() < 0.25 and abs(np.mean(errors)) < 0.07
    assert fingerprints.likeness(fingerprints.of_text(""), fingerprints.of_text(" ")) == 0 and fingerprints.likeness(fingerprints.of_text("a b"), fingerprints.of_text("")) == 0
    heavy = fingerprints.vector([b"same line of five words"] * 70_000)
    assert fingerprints.likeness(heavy, fingerprints.vector([b"same line of five words"] * 69_999)) > 0.99


def plain_edits(rows):
    rows = sorted(rows, key=lambda r: math.inf if r[0] is None else r[0])
    out = []
    for (doc_id, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        text, after = text or "", after or ""
        n = len(text)
        edited = text[: n - n // 2] + after[: n // 2]
        x, y, z = (fingerprints.of_text(t) for t in (text, edited, after))
        strings = hashlib.sha256(edited.encode()).hexdigest(), fingerprints.as_string(x), fingerprints.as_string(y)
        out.append((doc_id, n, *strings, fingerprints.likeness(x, y), fingerprints.likeness(x, z)))
    return sorted(out, key=str)


@pytest.mark.parametrize("part_bytes", [1 << 24, 2000])
def test_edits_by_the_next_document(spark, monkeypatch, part_bytes):
    monkeypatch.setattr(fingerprints, "PART_BYTES", part_bytes)
    rows = [(r.doc_id, r.text) for r in docs(spark).select("doc_id", "text").collect()]
    found = fingerprints.edited_by_next(docs(spark))
    assert sorted((tuple(r) for r in found.collect()), key=str) == plain_edits(rows)


def test_edits_of_odd_rows(spark):
    rows = [r for r in ODD if r[0] != 4] + [(4, "One two"), (4, "One two"), (9, "ää\nöö"), (10, "😀b\n\nc")]
    frame = spark.createDataFrame(rows, DOCS).withColumn("part", F.lit("x")).withColumn("fingerprint", F.lit(1)).repartition(4)
    assert sorted((tuple(r) for r in fingerprints.edited_by_next(frame).collect()), key=str) == plain_edits(rows)
    one = [(3, "a\nb\nc")]
    assert [tuple(r) for r in fingerprints.edited_by_next(spark.createDataFrame(one, DOCS)).collect()] == plain_edits(one)
    assert fingerprints.edited_by_next(spark.createDataFrame([], DOCS)).count() == 0


# --- 13: divergence -------------------------------------------------------------------------------------------------


def plain_audit(rows, least_docs, top=50):
    groups, df = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        found = collections.Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lowered(text)))
        groups[lang or "", source or ""].update(found)
        df[lang or ""].update(found.keys())
    out = []
    for lang, seen in df.items():
        kept = sorted(t for t, n in seen.items() if n >= least_docs)
        sources = sorted(s for g, s in groups if g == lang)

        def shares(counts, kept=kept):
            size = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // size for t in kept}

        p = {s: shares(groups[lang, s]) for s in sources}
        q = shares(sum((groups[lang, s] for s in sources), collections.Counter()))
        for s in sources:
            pairs = [("pair", o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [("term", t, p[s][t] - q[t]) for t in kept if groups[lang, s][t] and p[s][t] > q[t]]
            for part, most in ((pairs, None), (terms, top)):
                ranked = sorted(part, key=lambda x: (-x[2], x[1].encode()))[:most]
                out += [(lang, s, *x, i + 1) for i, x in enumerate(ranked)]
    return sorted(out)


def audited(found):
    return sorted(tuple(r) for r in found.collect())


def test_audit_equals_plain(spark):
    rows = [(r.text, r.lang, r.source) for r in docs(spark).select("text", "lang", "source").collect()]
    assert audited(divergence.audit(docs(spark), least_docs=10)) == plain_audit(rows, 10)


@pytest.mark.parametrize("bits", [4, 64])
def test_audit_splits_digests_of_several_terms(spark, monkeypatch, bits):
    monkeypatch.setattr(divergence, "TILE", 3)
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 4)
    monkeypatch.setattr(divergence, "HELD_TERMS", 50)
    rng = random.Random(8)
    names = [f"{a}{b}" for a in "abcdefé" for b in "xyzü"]
    rows = [(" ".join(rng.choices(names, k=8)).title(), rng.choice(["aa", "b", None]), rng.choice(["s1", "s2", "s3", "s4", "S5", None, "ü"])) for _ in range(150)]
    rows += [(None, "aa", "empty"), ("", None, "s1"), ("1 2 3", "lone", "x"), ("rare term", "lone", "y"), (names[0], "single", "x")] + [(names[1] + " x" * 5000, "b", "s1")] * 3
    frame = spark.createDataFrame(rows, "text string, lang string, source string").withColumn("digest", F.lit("x")).withColumn("item", F.lit(1)).repartition(3)
    assert audited(divergence.audit(frame, least_docs=12, top=5, bits=bits)) == plain_audit(rows, 12, 5)


def test_audit_of_nothing(spark):
    assert divergence.audit(spark.createDataFrame([], "text string, lang string, source string")).count() == 0


def test_shares_are_exact(spark):
    cases = [(0, 5), (7, 12), (10**14, 10**15 + 37), (123456789012345, 8 * 10**15 + 1)]
    found = spark.createDataFrame(cases, "n long, size long").select(divergence.share(F.col("n"), F.col("size")).alias("p")).collect()
    assert [r.p for r in found] == [1 + 1_000_000_000 * (n + 5) // size for n, size in cases]
