"""The training-data operators against brute-force versions, and their defined results in odd cases."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hirelake.llm import common, decontaminate, html, language, maxent, quality, sentencepieces, sharding, simhash, vectors, warc
from tests.conftest import SF

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "One two"), (4, "One two"), (None, "one TWO"), (5, "x" * 200_000), (6, "a b c d e f " * 3000)]


def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def reach(links, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        parent[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for n in nodes:
        groups[find(n)].append(n)
    return {n: min(g) for g in groups.values() for n in g}


# --- components ---------------------------------------------------------------------------------------------------


def test_components_of_a_long_chain_a_star_and_self_links(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(200, 260)] + [(7, 7), (None, 3)]
    found = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == reach([x for x in links if None not in x and x[0] != x[1]], [*range(41), 100, *range(200, 260)])


def test_components_of_nothing(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 1: SimHash ---------------------------------------------------------------------------------------------------


def plain_fingerprint(text, k=4):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components_equal_brute_force(spark):
    rows = docs(spark).collect()
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows}
    ids = sorted(prints)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if (prints[a] ^ prints[b]).bit_count() <= 4]
    want = reach(links, ids)
    found = simhash.simhash_components(docs(spark)).select("doc_id", simhash.hex_fingerprint().alias("f"), "component_id").collect()
    assert {r["doc_id"]: (r["f"], r["component_id"]) for r in found} == {i: (f"{prints[i]:016x}", want[i]) for i in ids}


def test_hot_keys_are_cut_without_loss(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_KEY", 7)
    rng = random.Random(8)
    prints = sorted({sum(1 << b for b in rng.sample(range(30), rng.randint(0, 5))) for _ in range(120)})
    links = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 4]
    found = simhash.fingerprint_links(simhash.pivot_table(spark.createDataFrame([(p,) for p in prints], "fp long")), 4).collect()
    assert reach([(r["a"], r["b"]) for r in found], prints) == reach(links, prints)


def test_simhash_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, DOCS).withColumn("fp", F.lit("clash")).withColumn("key", F.lit(1))
    found = collections.Counter((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.simhash_components(df).collect())
    two = plain_fingerprint("one two")
    assert found[(1, 0, 1)] == found[(2, 0, 1)] == found[(3, 0, 1)] == 1
    assert found[(4, two, 4)] == 2 and found[(None, two, 4)] == 1
    assert simhash.simhash_components(df.limit(0)).count() == 0


def test_hashes_are_spark_s_xxhash64(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("wörd a"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest("wörd a", 42)


@pytest.mark.parametrize("n", [30, 3000])
def test_links_of_small_and_large_runs(n):
    rng = np.random.default_rng(n)
    f = np.unique(np.array([sum(1 << int(b) for b in rng.choice(20, rng.integers(0, 7), replace=False)) for _ in range(n)], np.uint64))
    a, b = simhash._large_run(f, np.bitwise_count(f[:, None] ^ simhash.PIVOTS[None]).astype(np.int8), 4)
    near = [(int(x), int(y)) for i, x in enumerate(f.tolist()) for y in f[:i].tolist() if (x ^ y).bit_count() <= 4] if n < 100 else None
    if near is not None:
        nodes = f.tolist()
        assert reach(zip(a.tolist(), b.tolist()), nodes) == reach(near, nodes)
    assert len(a) < len(f)


def test_pivot_table_holds_distances_and_discards_no_pair_within_the_radius(spark):
    rng = np.random.default_rng(4)
    f = rng.integers(-(1 << 63), 1 << 63, 400)
    found = {r["fp"]: np.array([r["pivots_0"], r["pivots_1"]], np.int64).view(np.int8).tolist() for r in simhash.pivot_table(spark.createDataFrame([(int(x),) for x in f], "fp long")).collect()}
    table = np.bitwise_count(f.view(np.uint64)[:, None] ^ simhash.PIVOTS[None]).astype(np.int8)
    assert all(found[int(x)] == row for x, row in zip(f, table.tolist()))
    x, y = np.triu_indices(len(f), 1)
    assert simhash.pivots_keep(table[x], table[y], 4).mean() < 0.002
    near = f.view(np.uint64) ^ np.array([sum(1 << int(b) for b in rng.choice(64, 4, replace=False)) for _ in f], np.uint64)
    assert simhash.pivots_keep(table, np.bitwise_count(near[:, None] ^ simhash.PIVOTS[None]).astype(np.int8), 4).all()


def test_pigeonhole_masks_miss_nothing():
    rng = random.Random(5)
    masks = simhash.block_masks(4, 3)
    for _ in range(2000):
        d = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any(d & m == 0 for m in masks)


def test_near_copies_keep_one_row_of_each_group(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(vocabulary) for _ in range(300)] for _ in range(6)]
    near = [[*b[:100], "changed", *b[101:200], "twice", *b[201:]] for b in base[:3]]
    half = [[*base[3][:150], *[rng.choice(vocabulary) for _ in range(150)]]]
    texts = [*base, *near, *half, base[0]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], DOCS).withColumn("component", F.lit("clash"))
    assert sorted(r["doc_id"] for r in simhash.without_near_copies(df).collect()) == [0, 1, 2, 3, 4, 5, 9]
    odd = simhash.without_near_copies(spark.createDataFrame(ODD, DOCS))
    assert sorted(r["doc_id"] for r in odd.collect()) == [1, 4, 5, 6]
    assert simhash.without_near_copies(df.limit(0)).count() == 0


def families(seed, sizes, changed, words=160):
    """Texts in families: each copy has some of its words changed, so that cosines of 5-word shingles lie on both sides of 0.8."""
    rng = random.Random(seed)
    out = []
    for size in sizes:
        base = [f"w{rng.randrange(4000)}" for _ in range(words)]
        for _ in range(size):
            t = list(base)
            for at in rng.sample(range(words), rng.randint(*changed)):
                t[at] = f"x{rng.randrange(10**6)}"
            out.append(" ".join(t))
    return out


def shingle_set(text, k=5):
    w = text.lower().split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


@pytest.mark.parametrize("cut", [False, True])
def test_near_copies_equal_brute_force(spark, monkeypatch, cut):
    if cut:  # keys are cut into chunks, list no more than a forest at first, and are looked at again
        monkeypatch.setattr(simhash, "HOT_BAND", 16)
        monkeypatch.setattr(simhash, "SMALL_RUN", 2)
        monkeypatch.setattr(simhash, "LISTED", 0.25)
        monkeypatch.setattr(simhash, "PAIR_TILE", 64)
    texts = families(7, [60, 8, 8, 2, 2, 1, 1], (2, 7))
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for a in range(len(texts)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * (len(sets[a]) * len(sets[b])) ** 0.5]
    assert 20 < len(links) < 1500
    want = reach(links, range(len(texts)))
    rows = spark.createDataFrame(list(enumerate(texts)), "row long, text string")
    found = collections.defaultdict(list)
    for r in simhash.similar_rows(rows).collect():
        found[r["component"]].append(r["row"])
    got = {n: min(g) for g in found.values() for n in g}
    assert sum(got[n] == want[n] for n in got) >= 0.95 * len(texts)
    assert all(want[n] == want[got[n]] for n in got)  # nothing is put together that brute force keeps apart


# --- 2: quality ---------------------------------------------------------------------------------------------------


def test_quality_ranks_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    found = quality.classify(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in found if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert all((r["score"] >= 0.3) == (r["predicted"] == 1) and 0 <= r["score"] <= 1 for r in found)


def test_quality_of_odd_rows_and_without_labels(spark):
    df = spark.createDataFrame(ODD, DOCS).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(4, 1, 0), (4, None, None), (None, 0, 0), (99, 0, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    found = quality.classify(df, labels).collect()
    assert len(found) == len(ODD) and {r["score"] for r in found} == {0.5}
    assert quality.classify(df.limit(0), labels.limit(0)).count() == 0
    assert np.isfinite(quality.features(b"")).all()


# --- 3: sharding --------------------------------------------------------------------------------------------------


def test_lookup_table_is_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    table = sharding.lookup_table(names, 1009)
    sizes = collections.Counter(table)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    fewer = sharding.lookup_table(names[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer) if a != 9) < 0.2 * 1009
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 1000)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"])


def test_placement(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b")], "k long, v string")
    found = sharding.place(df, ["k"], ["x", "y"], 11).collect()
    table = sharding.lookup_table(["x", "y"], 11)
    slot = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16) % 11
    assert sorted((r["v"], r["slot"], r["shard"]) for r in found) == sorted([("a", slot("1"), table[slot("1")])] * 2 + [("b", slot("\\N"), table[slot("\\N")])])
    with pytest.raises(ValueError):
        sharding.place(df.withColumn("shard", F.lit(1)), ["k"], ["x"])


# --- 4: main text -------------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>x</title><script>var a="</p>";</script></head><body class="no-comments">
<div id="cookie-banner">We use cookies</div><nav><a href=/>Home</a></nav><div class="content post-{n}">
<h1>Title &amp; more</h1><p>First   <b>bold</b> text<br>and a line, with <a href=x>a link</a>.<p>Second &lt;p&gt; paragraph, long enough to matter here.
<div class="adSlot ad">Buy now</div><ul><li>one item<li>two items</ul><section id="comments"><p>Nice article, thanks a lot for it!</p></section></div>
<aside>More stories to read</aside><form>Search <input name=q></form><footer>&copy; x</footer></body></html>"""
TEXT = "Title & more\n\nFirst bold text and a line, with a link.\n\nSecond <p> paragraph, long enough to matter here.\n\none item\n\ntwo items"


def test_main_text(spark):
    rows = [(i, f"http://h{i % 2}.com/{i}", PAGE.replace("{n}", str(i))) for i in range(4)] + [(9, None, None), (10, "odd", ""), (10, "odd", "<p>plain text"), (None, "http://h0.com/", "no <b tags")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("clash")).withColumn("host", F.lit("clash"))
    found = collections.Counter((r["page_id"], r["text"], r["n_chars"]) for r in html.extract_pages(df).collect())
    assert found == collections.Counter([*[(i, TEXT, len(TEXT)) for i in range(4)], (9, "", 0), (10, "", 0), (10, "plain text", 10), (None, "no", 2)])
    assert html.extract_pages(df.limit(0)).count() == 0


def test_host_paths_are_voted(spark):
    rows = [(f"http://a.com/{i}", PAGE.replace("{n}", str(i))) for i in range(3)]
    found = html.host_paths(spark.createDataFrame(rows, "url string, html string").withColumn("host", html.host(F.col("url")))).collect()
    assert [tuple(r) for r in found] == [("a.com", "body>div.content.post-#")]


# --- 5: language model --------------------------------------------------------------------------------------------


def test_language_model_counts_and_scores(spark):
    rows = docs(spark).collect()
    tokens = {r["doc_id"]: [*(r["text"] or "").encode().lower().split(), b"\n"] for r in rows}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    c = collections.Counter(w for i, t in tokens.items() if not held[i] for w in t)
    n, v = sum(c.values()), len(c)
    found = maxent.score_documents(docs(spark).withColumn("key", F.lit("clash"))).collect()
    for r in found:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
    assert sum(r["score"] for r in found if not r["held_out"]) > sum(r["base_score"] for r in found if not r["held_out"])


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    w = rng.standard_normal((maxent.STARTS[-1], maxent.CLASSES)).astype(np.float32)
    rows, classes = maxent.encoded([b"a", b"b", b"\n", b"c", b"\n"], np.array([3, 2]), maxent._Codes({}))
    assert np.allclose(np.exp(maxent.log_softmax(w, rows)).sum(axis=1), 1, atol=1e-5)
    again, _ = maxent.encoded([b"c", b"\n"], np.array([2]), maxent._Codes({}))
    assert (rows[3:] == again).all(), "a text's history starts with it"


def test_language_model_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, DOCS)
    found = maxent.score_documents(df).collect()
    assert len(found) == len(ODD) and all(math.isfinite(r["score"]) for r in found)
    assert {r["n_tokens"] for r in found if r["doc_id"] in (1, 2, 3)} == {1}
    assert maxent.score_documents(df.limit(0)).count() == 0


# --- 6: decontamination -------------------------------------------------------------------------------------------


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(400)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {i: say(rng.randint(15, 40)) for i in range(8)} | {8: ["only", "three", "words"]}
    texts = {}
    for i in range(40):
        body = say(rng.randint(0, 200))
        if i % 2:
            part = list(items[i % 9])
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                part[rng.randrange(len(part))] = "new"
            body[10:10] = part
        texts[i] = body

    def shingles(w):
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))

    want = {}
    for d, w in texts.items():
        for i, item in items.items():
            for s in range(max(1, len(w) - len(item) + 1)):
                a, b = shingles(w[s : s + len(item)]), shingles(item)
                sim = sum((a & b).values()) / sum((a | b).values())
                if sim >= 0.8:
                    want[(d, i)] = max(want.get((d, i), 0), sim)
    df = spark.createDataFrame([(d, " ".join(w).upper()) for d, w in texts.items()], DOCS)
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] + [(77, None), (78, "")], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_matches(df, bench).collect()}
    assert found == pytest.approx(want) and found
    parts = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontaminate.find_matches(df, bench, part_bytes=200).collect()}
    assert parts == pytest.approx(want)
    clean = {r["doc_id"] for r in decontaminate.decontaminated(df, bench).collect()}
    assert clean == set(texts) - {d for d, _ in want}


def test_decontamination_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, DOCS).withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(1, "one two"), (1, "one two")], "item_id long, text string")
    found = decontaminate.find_matches(df, bench).collect()
    assert sorted((r["doc_id"] or 0) for r in found) == [0, 0, 4, 4, 4, 4]
    assert decontaminate.find_matches(df, bench.limit(0)).count() == 0
    assert decontaminate.find_matches(df.limit(0), bench).count() == 0


# --- 7: embeddings ------------------------------------------------------------------------------------------------


def test_embedding_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SLAB_ROWS", 60)
    rng = np.random.default_rng(2)
    base = rng.standard_normal((120, 64))
    near = base[:40] + rng.standard_normal((40, 64)) * rng.uniform(0.1, 0.5, (40, 1))
    x = np.concatenate([base, near, base[:5], base[:3] * 2]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    bad = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, [], 1), (904, [1.0, None], 1), (905, [1.0, 1.0], 1), (905, [2.0, 2.0], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit("clash"))
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    linked = (u @ u.T) >= 0.95
    np.fill_diagonal(linked, False)
    comp = reach(list(zip(*[a.tolist() for a in np.nonzero(linked)])), range(len(x)))
    found = vectors.embedding_components(df).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found if r["vec_id"] < 900} == {i: (int(linked[i].sum()), comp[i], comp[i] == i) for i in range(len(x))}
    odd = sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in found if r["vec_id"] >= 900)
    assert odd == [(i, 0, i) for i in (900, 901, 902, 903, 904)] + [(905, 1, 905)] * 2
    assert vectors.embedding_components(df.limit(0)).count() == 0


# --- 8: WARC ------------------------------------------------------------------------------------------------------


def test_warc_round_trip_with_magic_in_payloads(spark):
    record = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:hirelake:page:99>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    rows = [
        (1, "http://a", "<p>" + "x" * 200), (2, None, "<p>" + "x" * 200), (3, "http://b\r\nEvil: 1", warc.MAGIC), (4, "u", warc.MAGIC * 5 + record * 2 + "é" * 30 + warc.MAGIC), (5, "u", None), (6, "u", ""),
        (None, "u", "q" * 150), (7, "u", "q" * 150), (8, "u", "small"), (9, "u", "small"), (10, "u", "\r\n\r\n" + record + "\r\n\r\n"), (11, "u", record[:-4]), (12, "u", "é漢" * 100), (12, "u", "é漢" * 100), (13, "u", "é漢" * 100),
    ]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2).withColumn("digest", F.lit("clash"))
        found = warc.round_trip(df).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    payload = lambda h: (h or "").encode()
    want = collections.Counter((i, len(payload(h)), hashlib.sha256(payload(h)).hexdigest()) for i, _, h in rows)
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in found) == want
    assert {r["page_id"]: r["refers_to"] for r in found if r["record_type"] == "revisit"} == {2: 1, None: 7, 13: 12}
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_is_whole_where_files_are_split_otherwise_in_the_second_read(spark, monkeypatch):
    rows = [(i, "u", f"{i} " + (warc.MAGIC + "x" * 40) * (i % 4)) for i in range(40)]
    before, first = spark.conf.get("spark.sql.files.maxPartitionBytes"), warc.reachable

    def other(found):
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        return first(found)

    monkeypatch.setattr(warc, "reachable", other)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        found = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert {(r["page_id"], r["payload_digest"]) for r in found} == {(i, hashlib.sha256(h.encode()).hexdigest()) for i, _, h in rows} and len(found) == len(rows)


def test_fake_chains_are_not_reached(spark):
    found = spark.createDataFrame([("f", 0, 100), ("f", 40, 60), ("f", 60, 250), ("f", 100, 200), ("f", 200, None), ("g", 10, 20)], "file string, at long, next long").withColumn("whole", F.lit(True))
    assert sorted(r["at"] for r in warc.reachable(found).collect()) == [0, 100, 200]


# --- 9: language --------------------------------------------------------------------------------------------------


def test_language_of_held_out_rows(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(d).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in found]) > 0.97


def test_language_of_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (3, "der hund und die katze", "de"), (4, "der hund und die katze", None), (5, None, "en"), (6, "", None), (None, "123 !?", "en"), (7, "чужой", None)]
    df = spark.createDataFrame([(i, t * 3 if t else t, x) for i, t, x in rows * 2], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(df, modulus=1000, remainder=999).collect()}
    assert found[1][0] == "en" and found[3][0] == found[4][0] == "de" and found[5] == found[6] == found[None] == ("und", 0.0)
    assert found[7][0] in ("en", "de") and found[7][1] == 0.0
    assert {r["lang_pred"] for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(df.limit(0)).count() == 0


# --- 10: SentencePiece --------------------------------------------------------------------------------------------

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_pieces_equal_the_library_s():
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    coder = sentencepieces.Coder(sentencepieces.Vocabulary.load(MODEL))
    rng = random.Random(1)
    letters = "  ▁\n\t\r\x00abcdeth'.<>s/0x é漢𝄞ñ   THE123"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    texts += ["", " ", "\n", "a" * 5000, " " * 100 + "x", "the quick brown fox " * 200, "<s></s><unk><0x0A>"]
    for t in texts:
        ids, raw = coder.encode(t)
        want = library.encode(t, add_eos=True)
        assert ids.tolist() == want and raw.decode("utf-8", "replace") == library.decode(want) == coder.decode(want), repr(t)


def test_encode_decode_frames(spark):
    df = spark.createDataFrame(ODD, DOCS).withColumn("ids", F.lit("clash"))
    found = sentencepieces.encode_decode(df, MODEL).collect()
    assert len(found) == len(ODD) and all(r["decoded"] == (r["text"] or "") for r in found)
    assert [r["ids"] for r in found if r["doc_id"] in (1, 2)] == [[2], [2]]
    back = sentencepieces.decode(spark.createDataFrame([([450, 2],), (None,), ([],)], "ids array<int>"), MODEL).collect()
    assert [r["decoded"] for r in back][1:] == [None, ""]
    assert sentencepieces.encode_decode(df.limit(0), MODEL).count() == 0


# --- pipeline -----------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_copies", "benchmark", "tokens"]
    frame = docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = common.through_disk(stage(spark, frame, SF), name)
        kept, given = {r["doc_id"] for r in out.select("doc_id").collect()}, {r["doc_id"] for r in frame.select("doc_id").collect()}
        assert kept <= given and kept
        if name != "tokens":
            assert out.columns == frame.columns
        if name == "benchmark":
            hits = {r["doc_id"] for r in decontaminate.find_matches(frame, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert kept == given - hits
        frame = out


def test_pipeline_stages_take_odd_and_no_rows(spark):
    import corpus_pipeline

    full = spark.createDataFrame([(i, t, None, None, None) for i, t in ODD], docs(spark).schema)
    for frame in (full, full.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, frame, SF).count() <= len(ODD)
