"""Cases in which an operator once did less than the whole job."""

from urllib.parse import urlsplit

import numpy as np
from pyspark.sql import functions as F

from hirelake.llm import html, maxent, vectors
from tests.conftest import SF


def test_frequent_words_above_any_count(spark, monkeypatch):
    rows = [(f"w{i}".encode(), 2000 + i % 5 * 17) for i in range(40)] + [(b"rare", 1)]
    counts = spark.createDataFrame(rows, "word binary, c long")
    for bins in (2, 1024):
        monkeypatch.setattr(maxent, "COUNT_BINS", bins)
        for top in (41, 40, 16, 8, 7):
            least = min([c for _, c in rows if sum(d >= c for _, d in rows) <= top], default=None)
            assert sorted(maxent._most_frequent(counts, top)) == sorted((w, c) for w, c in rows if least is not None and c >= least)


def test_training_without_a_bounded_list(spark, monkeypatch):
    monkeypatch.setattr(maxent, "_most_frequent", lambda counts, top=0: [])
    text = spark.createDataFrame([(i, f"the cat sat on the mat w{i % 7}") for i in range(40)], "key long, text string")
    model, _ = maxent.train(text)
    assert b"the" in model.singles
    assert (model.weights[1:] != 0).any() and {b"the", maxent.END} <= set(model.top)


PROSE = "A sentence of the article, long enough to be taken as prose by any measure. " * 4


def page(wrapper, inner="{}", tail=""):
    return f"<body><nav><a>Home</a></nav><div {wrapper}>{inner.format(f'<p>{PROSE}</p>')}</div>{tail}</body>"


def text_of(source):
    return html.extract(source, None)


def test_noise_words_inside_other_tokens():
    for names in ("class='content-with-sidebar'", "class='no-sidebar'", "class='post has-comments'", "id='share-prices'", "class='related-work'"):
        tail = "<div class='sidebar'>Other things to read</div>"
        assert text_of(page(names, tail=tail)) == PROSE.strip(), names
    for names in ("sidebar-left", "site-footer", "comment-list", "adSlot-3", "related-posts", "cookie-banner"):
        assert text_of(page("class='post'", tail=f"<div class='{names}'>Bought here</div>")) == PROSE.strip(), names


def test_marked_wrapper_of_the_article():
    assert text_of(page("class='layout sidebar'")) == PROSE.strip()
    assert text_of(page("class='widget'", "<div class='share'>{}</div>")) == PROSE.strip()
    other = f"<div>{'Words that stand elsewhere on the page. ' * 3}</div>"
    for tag in ("article", "main"):
        assert PROSE.strip() in text_of(page("class='modal'", f"<{tag}>{{}}</{tag}>", other)), tag


def test_long_comments_stay_noise():
    talk = "".join(f"<article class='comment'><p>{PROSE}</p></article>" for _ in range(6))
    assert text_of(page("class='post'", tail=f"<div id='comments'>{talk}</div>")) == PROSE.strip()
    assert text_of(page("class='post'", tail=f"<div id='comments'>{talk.replace(' class=', ' data-x=')}</div>")) == PROSE.strip()


def test_reference_lists_of_the_article():
    refs = "<h2>References</h2><ul><li><a>First source</a></li><li><a>Second source</a>, 1999</li></ul>"
    found = text_of(page("class='post'", "{}" + refs, "<div><div><a>Imprint</a></div></div>"))
    assert found == "\n\n".join([PROSE.strip(), "References", "First source", "Second source, 1999"])


def test_link_lists_inside_the_article_stay():
    found = text_of(page("class='post'", "{}<ul><li><a>Reference one long</a></li><li>plain</li></ul>"))
    assert found == "\n\n".join([PROSE.strip(), "Reference one long", "plain"])


def test_all_classes_count_for_a_path():
    names = " ".join(f"c{chr(97 + i)}" for i in range(12))
    path = html.best_path(page(f"class='{names} last'"))[0]
    assert path == "body>div." + ".".join(sorted([*names.split(), "last"]))


def test_hidden_parts_of_a_line_are_left_out():
    assert text_of("<p>One <span hidden>secret</span> line<svg><text>drawn</text></svg> of text, <noscript>off</noscript>whole.</p>") == "One line of text, whole."


def test_very_deep_and_very_long_pages():
    for wrapper in ("<div>", "<div class=sidebar>", "<span>", "<td>"):
        assert text_of(wrapper * 50_000 + PROSE) == PROSE.strip()
    assert text_of(f"<div {'a' * 300_000}>{PROSE}</div>") == PROSE.strip()
    long = "".join(f"<p>Line {i} of <b>a long page</i></span> here" for i in range(110_000))
    assert len(long) > 5_000_000 and text_of(long).count("\n\n") == 110_000 - 1


def test_extraction_equals_brute_force_votes(spark):
    short, long = f"<div class='post'><p>{PROSE}</p></div>", f"<div class='talk'>{PROSE * 3}</div>"
    more = [(-i, "http://one.test/", f"<body>{short}<nav>x</nav>{long if i == 1 else ''}</body>") for i in range(1, 5)]
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").unionByName(spark.createDataFrame(more, "page_id long, url string, html string"))
    rows = pages.collect()
    votes = {}
    for r in rows:
        host = (urlsplit(r["url"] or "").hostname or "").lower()
        votes.setdefault(host, {})
        if found := html.best_path(r["html"] or ""):
            votes[host][found[0]] = votes[host].get(found[0], 0) + round(found[1] * 1e6)
    won = {h: min(v, key=lambda p: (-v[p], p)) if v else None for h, v in votes.items()}
    want = {r["page_id"]: html.extract(r["html"] or "", won[(urlsplit(r["url"] or "").hostname or "").lower()]) for r in rows}
    found = html.extract_pages(pages).collect()
    assert {r["page_id"]: (r["text"], r["n_chars"]) for r in found} == {i: (t, len(t)) for i, t in want.items()}
    assert won["one.test"] == "body>div.post" and html.best_path(more[0][2])[0] != "body>div.post" and want[-1] == PROSE.strip()


def test_slabs_are_dealt_by_pairs_of_chunks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((150, 16)), rng.standard_normal(16) + 0.1 * rng.standard_normal((150, 16))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = (unit @ unit.T >= 0.95).sum(axis=1) - 1
    monkeypatch.setattr(vectors, "CHUNK_CELLS", 16 * 40)
    monkeypatch.setattr(vectors, "SLAB_ROWS", 150)
    groups = []
    grouped = vectors._grouped

    def kept(*args):
        groups.append(grouped(*args))
        return groups[0]

    monkeypatch.setattr(vectors, "_grouped", kept)
    found = {r["vec_id"]: r["n_links"] for r in vectors.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert found == {i: int(n) for i, n in enumerate(links)} and links.sum() > 1000
    assert groups[0].groupBy("dim", "block", "slab", "one", "two").count().agg(F.max("count")).first()[0] <= 2 * 40 * 1.6
