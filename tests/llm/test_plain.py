"""Learned operators and the whole pipeline against plain versions: a loop over texts, no batches, no blocks, no filter."""

import collections
import math
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from hirelake.llm import decontaminate, language, maxent, quality
from tests.conftest import SF

ODD = ["", " \n\t", "one two", "ONE  two.", "É à 中文 ру", "x" * 5000, "a b c d e f " * 300]


def sample(spark, n=60):
    return [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(n).collect()] + ODD


# --- 2: quality ---------------------------------------------------------------------------------------------------


def plain_features(text):
    kinds = []
    for c in text:
        k = len(quality.MARKS) + 6
        if ord(c) < 0x250:
            k = 6 + quality.MARKS.index(c) if c in quality.MARKS else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 5 if c == "\n" else 4 if c.isspace() else 0
        kinds.append(k)
    single = [kinds.count(k) for k in range(quality.CLASSES)]
    pairs = collections.Counter((min(a, 6), min(b, 6)) for a, b in zip(kinds, kinds[1:]))
    n = len(text) + 20
    shares = np.array([*single, *[pairs[a, b] for a in range(7) for b in range(7)]]) / n
    raw = text.encode()
    tokens, lower = raw.split(), raw.lower().split()
    size = [len(t) for t in tokens] or [0]
    lines = [x for x in raw.split(b"\n") if x.strip()]
    mean = sum(size) / len(size)
    distinct = len(set(lower)) / max(1, len(lower))
    stats = [
        math.log1p(len(text)), math.log1p(len(tokens)), mean, math.sqrt(sum((x - mean) ** 2 for x in size) / len(size)), math.log1p(len(tokens) / max(1, len(lines))),
        len(set(lines)) / max(1, len(lines)), distinct if lower else 1.0, math.log(distinct + 0.01) if lower else 0.0,
        max(lower.count(w) for w in set(lower)) / len(lower) if len(lower) > 20 else 0.05, math.sqrt(sum(a == b for a, b in zip(lower, lower[1:])) / max(1, len(lower))),
        sum(x == 1 for x in size) / len(size), sum(x <= 3 for x in size) / len(size), sum(x > 12 for x in size) / len(size),
    ]
    return np.concatenate([np.log(shares + 1e-3), np.sqrt(shares), stats])


def test_quality_features_and_scores_equal_a_plain_version(spark):
    texts = sample(spark)
    assert all(np.allclose(quality.features(t.encode()), plain_features(t), atol=1e-5) for t in texts)
    model = quality.train_on_rest(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.score_documents(df, model).collect():
        z = np.clip((plain_features(r["text"]) - model.mean) / model.scale, -quality.CLIP, quality.CLIP)
        want = 1 / (1 + math.exp(-(float(z @ model.weights) - model.cut + math.log(3 / 7))))
        assert r["score"] == pytest.approx(want, abs=2e-3) and r["predicted"] == int(r["score"] >= 0.3)


# --- 9: language --------------------------------------------------------------------------------------------------


def plain_grams(text):
    t = "".join(c if c.isalpha() else " " for c in text.lower())
    t = " " + " ".join(t.split()) + " " if t.split() else "  "
    return [t[i : i + n] for n in language.ORDERS for i in range(len(t) - n + 1)]


def test_language_sets_equal_exact_sets(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    counts, most = collections.defaultdict(collections.Counter), {}
    for r in rows:
        if r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            counts[r["lang"]].update(plain_grams(r["text"] or ""))
    total = {x: sum(c.values()) for x, c in counts.items()}
    least = {x: language.MIN_COUNT if sum(n >= language.MIN_COUNT for n in c.values()) >= language.ENOUGH else 1 for x, c in counts.items()}
    for x, c in counts.items():
        for g, n in c.items():
            if n >= least[x]:
                most[g] = max(most.get(g, 0), n / total[x])
    sets = {x: {g for g, n in c.items() if n >= least[x] and n / total[x] >= language.RATIO * most[g]} for x, c in counts.items()}
    found = {r["doc_id"]: r for r in language.identify(spark.createDataFrame(rows)).collect()}
    same = 0
    for r in rows:
        hits = {x: sum(g in s for g in plain_grams(r["text"] or "")) for x, s in sets.items()}
        best = max(sorted(hits), key=hits.get)
        f = found[r["doc_id"]]
        if not any(c.isalpha() for c in r["text"] or ""):
            assert f["lang_pred"] == "und"
            same += 1
        elif sum(hits.values()):
            same += f["lang_pred"] == best and abs(f["score"] - hits[best] / sum(hits.values())) < 0.1
        else:
            same += f["score"] < 0.5
    assert same >= 0.99 * len(rows)


# --- 5: language model --------------------------------------------------------------------------------------------


def test_language_model_scores_equal_a_plain_version(spark):
    texts = sample(spark, 25)
    docs = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    model, counts = maxent.train(docs)
    c = {bytes(r["word"]): r["c"] for r in counts.collect()}
    codes = maxent._Codes(model.singles)
    mask = (1 << 64) - 1

    def mix(x, y):
        h = ((x * 0x9E3779B97F4A7C15) & mask) ^ y
        h = (h * 0xC2B2AE3D27D4EB4F) & mask
        return h ^ (h >> 31)

    def plain(text):
        tokens = [*text.encode().lower().split(), maxent.END]
        score = base = 0.0
        for i, w in enumerate(tokens):
            one, two, three = ((zlib.crc32(tokens[i - lag]) + 2) if i >= lag else 1 for lag in (1, 2, 3))
            z = model.weights[0].astype(np.float64).copy()
            for k, h in enumerate((mix(one, 1), mix(two, 2), mix(one, mix(two, 3)), mix(three, 4)), 1):
                z += model.weights[int(maxent.STARTS[k]) + h % maxent.ROWS[k]]
            of = codes[w] & 255
            p = math.exp(z[of] - z.max()) / sum(math.exp(x - z.max()) for x in z)
            score += math.log10(p) + math.log10((c.get(w, 0) + 1) / model.class_size[of])
            base += math.log10((c.get(w, 0) + 1) / (model.tokens + model.distinct + 1))
        return score, base

    other = [*texts[:6], "words that nobody has seen, the and of"]
    df = spark.createDataFrame(list(enumerate(other)), "key long, text string")
    for r in maxent.score_texts(df, model, counts).collect():
        assert (r["score"], r["base_score"]) == pytest.approx(plain(other[r["key"]]), rel=1e-4)


# --- pipeline -----------------------------------------------------------------------------------------------------


def shingles(words, k=5):
    return collections.Counter(" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else collections.Counter()


def holds(text, item):
    words, wanted = decontaminate.folded(text.encode()), decontaminate.folded(item.encode())
    if not wanted or not words:
        return False
    m, want = len(wanted), shingles([w.decode() for w in wanted])
    known = set(want)
    words = [w.decode() for w in words]
    if len(known & set(shingles(words, min(5, m)))) == 0:
        return False
    for s in range(max(1, len(words) - m + 1)):
        have = shingles(words[s : s + m])
        both = sum((have & want).values())
        if both >= 0.8 * (sum(have.values()) + sum(want.values()) - both) and both:
            return True
    return False


def test_pipeline_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train_on_rest(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = {r["doc_id"]: r for r in docs.collect() if model.score(quality.features((r["text"] or "").encode())[None].astype(np.float64))[0] >= 0.3}
    known = docs.where("lang IS NOT NULL").collect()
    known = [(r["lang"], r["text"]) for r in known if r["doc_id"] in rows and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    found = language.train(spark.createDataFrame(known, "lang string, text string"))
    rows = {i: r for i, r in rows.items() if (p := found.predict(r["text"]))[0] != "und" and p[1] > 0}
    kept = {}
    sets = {i: set(shingles([w.decode("latin-1") for w in (r["text"] or "").encode().lower().split()])) for i, r in rows.items()}
    group = {i: i for i in rows}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in sorted(rows):
        for j in sorted(rows):
            if j < i and len(sets[i] & sets[j]) >= 0.8 * math.sqrt(len(sets[i]) * len(sets[j])):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    kept = {i for i in rows if root(i) == i}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i in kept if not any(holds(rows[i]["text"], x) for x in items if x)}
    assert len(docs.collect()) > len(rows) > len(kept) > len(clean) > 0
    sp = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    # bands miss some pairs near 0.8: few documents stay for that, none of them with a near copy, and none goes that should stay
    missed = set(got) - clean
    assert clean <= set(got) and len(missed) <= 0.03 * len(clean)
    assert all(len(sets[i] & sets[j]) < 0.9 * math.sqrt(len(sets[i]) * len(sets[j])) for i in missed for j in kept if j < i)
    assert all(got[i]["ids"] == [*sp.encode(rows[i]["text"]), sp.eos_id()] and got[i]["n_tokens"] == len(got[i]["ids"]) for i in clean)
