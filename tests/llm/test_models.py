"""Quality, toxicity and HTML extraction: held-out accuracy, contracts and odd cases."""

import hashlib
import html as markup
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from helpers import labels, no_documents, odd_documents
from ranksheaf.llm import hashing, html_extract, quality, registry, toxicity

MEDIUM = "/root/testdata/sf0.1"


def test_word_hashes_follow_the_words():
    texts = ["One two\tTWO", "", None, "é x", "one"]
    h, counts = hashing.words_of(texts)
    assert counts.tolist() == [3, 0, 0, 2, 1]
    assert h[1] == h[2] and h[0] == h[5] and len(set(h.tolist())) == 4


def test_long_texts_hash_alike(monkeypatch):
    text = " ".join(f"w{i % 91}" for i in range(3000)).encode()
    whole = hashing.words(text)
    monkeypatch.setattr(hashing, "SEGMENT", 100)
    assert (hashing.words(text) == whole).all() and len(whole) == 3000
    assert (hashing.words(b"x" * 500 + b" " + b"y") == hashing.words_of(["x" * 500 + " y"])[0]).all()


def test_pairs_stay_inside_texts():
    b, owner = quality.buckets_of(["a b", "", "c", "d e f"])
    assert np.bincount(owner, minlength=4).tolist() == [3, 0, 1, 5] and len(b) == 9


def test_quality_on_held_out_labels(spark):
    out = registry.op9_quality(spark, MEDIUM).join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id")
    out = out.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    s = {(r.quality, r.kept): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert s.get((1, False), 0) < 0.02 * s[1, True] and s.get((0, True), 0) < 0.1 * s[0, False]


def test_the_reported_fold_has_no_influence(spark):
    docs, marks = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    turned = marks.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 7, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert turned.exceptAll(marks).count() > 0
    a, b = (sorted(map(str, quality.importance_resampling(docs, x).collect())) for x in (marks, turned))
    assert a == b


def gumbel(doc_id):
    u = (int(hashlib.md5(f"{quality.SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48)
    return -math.log(-math.log(u))


def test_the_draw_is_gumbel_top_k_and_matters(spark):
    rows = registry.op9_quality(spark, MEDIUM).collect()
    k = sum(r.kept for r in rows)
    keys = sorted(rows, key=lambda r: r.log_weight + gumbel(r.doc_id), reverse=True)
    assert {r.doc_id for r in keys[:k]} == {r.doc_id for r in rows if r.kept}
    assert all(abs(r.key - r.log_weight - gumbel(r.doc_id)) < 1e-6 for r in rows)
    cut = sorted((r.log_weight for r in rows), reverse=True)[k - 1]
    changed = sum(r.kept != (r.log_weight >= cut) for r in rows)
    assert 0.001 * len(rows) < changed < 0.03 * len(rows)


def plain_weights(texts, good):
    """Log weights by counting words and pairs with a Counter; buckets by the operator's own hash of one word or pair."""
    grams = lambda t: (w := re.findall(r"[^\x20\x09-\x0D]+", t)) + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]
    buckets = {g: int(quality.buckets_of([g])[0][-1]) for t in texts for g in grams(t)}
    target, raw = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(buckets[g] for g in grams(t))
        if i in good:
            target.update(buckets[g] for g in grams(t))
    share = sum(target.values()) / sum(raw.values())
    ratio = lambda b: math.log((target[b] + quality.PRIOR) / (raw[b] * share + quality.PRIOR))
    return [quality.UNITS * sum(ratio(buckets[g]) for g in grams(t)) / max(len(grams(t)), 1) for t in texts]


def test_weights_are_brute_force(spark):
    texts = [f"a b c d{i % 3} " * (1 + i % 4) for i in range(30)] + ["x y %% &&" * 5, "", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    good = set(range(0, 20, 2))
    ratio = quality.log_ratio(quality.counts(docs.where(F.col("doc_id").isin(*good))), quality.counts(docs))
    got = {r.doc_id: r.log_weight for r in quality.weighed(docs, ratio).collect()}
    assert [got[i] for i in range(len(texts))] == pytest.approx(plain_weights([t.lower() for t in texts], good), abs=1e-6)


def test_quality_odd_cases(spark):
    docs = odd_documents(spark)
    for marks in (labels(spark), labels(spark, [])):
        got = quality.importance_resampling(docs, marks)
        assert got.count() == docs.count()
        assert {r.log_weight for r in got.where("doc_id IN (1, 2, 3)").collect()} == {0.0}
    assert all(r.kept for r in got.collect())
    assert quality.importance_resampling(no_documents(spark), labels(spark)).count() == 0
    kept = quality.keep_good(docs, labels(spark))
    assert kept.columns == docs.columns
    twice = [sorted(map(str, quality.importance_resampling(docs.repartition(n), labels(spark)).collect())) for n in (1, 4)]
    assert twice[0] == twice[1]


@pytest.mark.parametrize("values", [[1.0, 2.0, 3.0, 4.0], [5.0] * 4, [0.0, 0.0, 0.0, 9.0], [1e-9, 1e9, -1e9, 0.0]])
def test_kth_largest(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for k in range(1, len(values) + 1):
        assert quality.kth_largest(df, "x", k, bins=3) == sorted(values, reverse=True)[k - 1]


def test_best_cut():
    assert quality.best_cut(np.array([2.0, 3.0]), np.array([-1.0, 0.0])) == 1.0
    assert quality.best_cut(np.array([1.0]), np.array([2.0])) <= 1.0


def test_toxicity_on_held_out_labels(spark):
    out = registry.op3_toxicity(spark, MEDIUM).where("held_out").join(spark.read.parquet(f"{MEDIUM}/labels.parquet"), "doc_id")
    s = {(r.toxic, r.predicted): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert s[1, 1] >= 0.9 * (s[1, 1] + s.get((1, 0), 0)) and s.get((0, 1), 0) <= 0.01 * s[0, 0]
    assert out.where("score < 0 OR score > 1 OR (score >= 0.7) <> (predicted = 1)").count() == 0


def test_toxicity_odd_cases(spark):
    docs = odd_documents(spark)
    many = [(i, 1, int(i in (9, 10, 11, 12))) for i in range(1, 17)]
    for marks in (labels(spark), labels(spark, []), labels(spark, many)):
        got = toxicity.toxicity(docs, marks)
        rows = got.collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows) and got.columns == ["doc_id", "held_out", "score", "predicted"]
        assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1 and len({r.score for r in rows if r.doc_id in (7, 8)}) == 1
    assert toxicity.toxicity(no_documents(spark), labels(spark)).count() == 0


def plain_features(text, lexicon):
    """The features one by one, each with a loop of its own."""
    edge, text = toxicity.EDGE, text or ""
    raw, low = text.split(), [w.strip(edge) for w in text.lower().split()]
    kinds, n = set(low), max(len(raw), 1)
    is_marked = lambda w: bool(w) and any(x in lexicon for x in (w, *(w[:k] + "*" for k in toxicity.BEGINNINGS if len(w) > k)))
    marked, insults = [i for i, w in enumerate(low) if is_marked(w)], [i for i, w in enumerate(low) if w in toxicity.INSULTS]
    hit = sorted({*marked, *insults})
    near = [any(low[j] in toxicity.YOU for j in range(max(0, i - toxicity.NEAR), min(len(low), i + toxicity.NEAR + 1))) for i in hit]
    ascii_letters, upper = sum(c.isascii() and c.isalpha() for c in text), sum("A" <= c <= "Z" for c in text)
    size = max(len(text.encode()), 1)
    punctuation = sum(c.isascii() and c.isprintable() and not c.isalnum() and c not in " !" for c in text)
    hidden = [w for w in kinds if w and not w.isalpha() and any(c.isalpha() for c in w)]
    drawn = [w for w in kinds if any(a == b == c and a.isalpha() for a, b, c in zip(w, w[1:], w[2:], strict=False))]
    return [
        math.log1p(len(raw)), len(insults) / n, len(marked) / n, math.log1p(len(marked)), len({low[i] for i in marked}), sum(near) / len(near) if near else 0.0, upper / max(ascii_letters, 1),
        sum(w.isupper() and len(w) > 1 for w in raw) / n, punctuation / size, text.count("!") / size, len(hidden) / max(len(kinds), 1),
        sum(w.translate(toxicity.LEET) in toxicity.INSULTS for w in hidden), len(drawn) / max(len(kinds), 1),
    ]


def test_features_are_brute_force(spark):
    lexicon = frozenset({"thth*", "ering", "idiot", "leoi*"})
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").collect()]
    for t in [*texts, None, "", "You IDIOT!! 1d10t, sooo st*pid", "\x1c é ÉÉ %", "a " * 5000 + "loser you"]:
        assert toxicity.features(t, lexicon) == pytest.approx(plain_features(t, lexicon))


def test_the_lexicon_does_not_see_the_calibration_fold(spark, monkeypatch):
    seen = []
    plainly = toxicity.learned_lexicon
    monkeypatch.setattr(toxicity, "learned_lexicon", lambda known: seen.append(known.where("apart").count()) or plainly(known))
    registry.op3_toxicity(spark, SMALL)
    assert seen == [0]


def test_features_see_what_they_are_named_for():
    f = dict(zip(toxicity.NAMES, toxicity.features("YOU are an IDIOT!! and a st0pid l0ser, nooo", frozenset({"idio*"})), strict=True))
    assert f["insults"] > 0 and f["learned"] > 0 and f["near_you"] == 1 and f["shouted"] > 0 and f["obfuscated"] > 0 and f["obfuscated_insults"] >= 1 and f["drawn_out"] > 0
    assert len(toxicity.features(None, frozenset())) == len(toxicity.NAMES)


@pytest.fixture(scope="module")
def trees(spark):
    return html_extract.train(spark.read.parquet(f"{SMALL}/pages.parquet"))


def text_of(html, model):
    nodes, blocks = html_extract.parse(html)
    return html_extract.main_text(nodes, blocks, model.chance(np.array(html_extract.node_features(nodes, blocks))))


def test_articles_come_out_whole(spark):
    rows = registry.op6_html_extract(spark, SMALL).join(spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "html"), "page_id").collect()
    for r in rows:
        body = re.sub(r"<[a-zA-Z/][^>]*$", "", r.html[r.html.find("<article>") + 9 :].partition("</article>")[0])
        want = [" ".join(markup.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(w for w in want if w) and r.n_chars == len(r.text)


LINES = " ".join(f"Words of the story go on, and {i} more come after." for i in range(12))


@pytest.mark.parametrize(
    "html",
    [
        "<body><div class='menu'><ul><li><a href=/>Home</a><li><a href=/x>News</a></ul></div><div class='content'><h1>Title</h1><p>{0}</p><p>{0}</p></div><div class='footer'>&copy; us</div></body>",
        "<main><h1>Title</h1><p>{0}<p>{0}<section class='comments'><h3>Comments</h3><p>First!</p></section></main><aside class='sidebar'><p>See also</p></aside>",
        "<header>Site</header><article><h1>Title</h1><p>{0}</p><div class='ad'>Buy now</div><p>{0}</p></article><form><p>Sign up</p><input></form><div class='cookie-notice'>We use cookies.</div>",
    ],
)
def test_other_layouts(trees, html):
    assert text_of(html.format(LINES), trees) == f"Title\n\n{LINES}\n\n{LINES}"


TEXT = "A long sentence of the article, with some commas, that goes on for a while and then ends."


@pytest.mark.parametrize("name", ["post", "hentry", "post category-social", "post tag-share", "post comments-open", "post type-post status-publish format-standard has-post-thumbnail category-legal tag-newsletter"])
@pytest.mark.parametrize("tag", ["article", "div"])
def test_class_names_that_only_sound_like_boilerplate(trees, name, tag):
    html = f'<html><body><nav><a href="/">Home</a> <a href="/b">B</a></nav><{tag} class="{name}"><h1>Title</h1><p>{TEXT} 1</p><p id="copyright-law">{TEXT} 2</p><p>{TEXT} 3</p></{tag}><footer><p>Copyright 2020</p></footer></body></html>'
    nodes, blocks = html_extract.parse(html)
    text = html_extract.main_text(nodes, blocks, trees.chance(np.array(html_extract.node_features(nodes, blocks))))
    assert text == "\n\n".join(["Title", *(f"{TEXT} {i}" for i in (1, 2, 3))])


def test_a_layout_without_names(trees):
    html = f'<body><div><a href="/">Home</a> <a href="/b">B</a> <a href="/c">Contact us</a></div><div><h1>Title</h1><p>{TEXT} 1</p><p>{TEXT} 2</p><p>{TEXT} 3</p></div><div>Copyright 2020</div></body>'
    nodes, blocks = html_extract.parse(html)
    text = html_extract.main_text(nodes, blocks, trees.chance(np.array(html_extract.node_features(nodes, blocks))))
    assert [f"{TEXT} {i}" in text for i in (1, 2, 3)] == [True] * 3 and "Contact us" not in text


@pytest.mark.parametrize("html,names", [('<div class="site-footer">', {"site", "footer"}), ('<section id="related-work">', {"work"}), ('<div id="cookie-notice">', {"notice"}), ('<h2 id="share-prices">', {"share-prices"}), ('<li class="comment">', {"comment"}), ("<div class='category-social comments-closed'>", {"category-social", "comments-closed"})])
def test_names_of_elements(html, names):
    assert html_extract.parse(html + "x")[0][1].names == names


@pytest.mark.parametrize(
    "html,blocks",
    [
        ("a < b &amp; c<br>d", ["a < b & c d"]), ("<p>x<p>y", ["x", "y"]), ("<p title='a>b'>x</p>", ["x"]), ("<script>var t='</p>';</script>z", ["z"]), ("<!-- <p>no</p> -->yes", ["yes"]), ("<p>cut <b", ["cut"]),
        ("<p>a&nbsp;b\n c &am", ["a b c &am"]), ("</div></p>x", ["x"]), ("<title>t</title><style>p{}</style>x", ["x"]), ("<script>never ends", []), ("", []), ("<ul><li>a<li>b</ul>c", ["a", "b", "c"]), ("<head><meta x></head><body>b", ["b"]),
    ],
)
def test_parsing(html, blocks):
    assert [t for _, t in html_extract.parse(html)[1]] == blocks


@pytest.mark.parametrize(
    "html,blocks",
    [
        ("<head><title>x</title><main><h1>Heading</h1><p>a</main>", ["Heading", "a"]), ("<head><title>x</title><section>a</section>", ["a"]), ("<head> <meta x>text<p>a", ["text", "a"]), ("<head><template><div>no</div></template></head>a", ["a"]),
        ("<head><template><div>no</head><p>a", ["a"]), ("<div><svg><path d=x></div><p>a", ["a"]), ("<main><svg><path d=x><p>a</main>b", ["a", "b"]), ("<p><svg><svg/><svg><text>x</text></svg>y</svg>a", ["xya"]), ("<svg><foreignObject><p>b</p></foreignObject></svg>a", ["b", "a"]),
        ("<svg><title/><text>x</text></svg>a", ["xa"]), ("<div><canvas>b</div><p>a", ["b", "a"]), ("<span><canvas>b</span>a", ["ba"]), ("<p>a<canvas>x<p>b", ["ax", "b"]), ("<div><object><div>b</div>c</object>a</div>", ["b", "ca"]), ("<div><object><p>b</div>a", ["b", "a"]),
        ("<p>Energy is <math><mi>E</mi></math> here<p>a<noscript>b</noscript><textarea>no</textarea><iframe>no</iframe>", ["Energy is E here", "ab"]), ("<div><template><p>no</div>a", ["a"]), ("a</é x='1'>b<p>c", ["ab", "c"]), ("a<b></é>b</b>", ["ab"]), ("<head><link x></head><p>a", ["a"]),
    ],
)
def test_unclosed_parts_lose_no_text(html, blocks):
    assert [t for _, t in html_extract.parse(html)[1]] == blocks


def test_nothing_below_a_left_out_node_is_main():
    nodes, blocks = html_extract.parse("<article><p>aaa</p><div><p>bbb</p><p>ccc</p></div></article>")
    rng = np.random.default_rng(1)
    for _ in range(200):
        keep = html_extract.decode(nodes, rng.random(len(nodes)))
        for n, k in zip(nodes, keep, strict=True):
            up, seen = n.parent, False
            while k and up:
                seen = seen or keep[up.at]
                assert keep[up.at] or not seen
                up = up.parent


def test_decoding_is_the_best_assignment():
    from itertools import product

    nodes, blocks = html_extract.parse("one<div>two<p>three</p></div><p>four</p>")
    html_extract.node_features(nodes, blocks)
    rng = np.random.default_rng(2)

    def value(chance, keep):
        return sum(np.sqrt(n.text) * np.log(c if k else 1 - c) for n, c, k in zip(nodes, chance, keep, strict=True))

    def allowed(states):
        return all(n.parent is None or (states[n.parent.at], s) not in ((1, 0), (2, 0), (2, 1)) for n, s in zip(nodes, states, strict=True))

    for _ in range(50):
        chance = rng.uniform(0.01, 0.99, len(nodes))
        best = max(value(chance, [s == 1 for s in states]) for states in product(range(3), repeat=len(nodes)) if allowed(states) and states[0] < 2)
        assert value(chance, html_extract.decode(nodes, chance)) == pytest.approx(best)


def test_training_pages_are_drawn_from_those_with_labels(spark):
    plain = [(i, "<div><p>No label here.</p></div>") for i in range(300)] + [(300 + i, "<!-- <article> --><p>None here.</p>") for i in range(300)]
    good = [(1000 + i, f"<nav><a href=/>Home</a></nav><article><p>{LINES}</p></article>") for i in range(8)]
    pages = spark.createDataFrame(plain + good, "page_id long, html string")
    assert isinstance(html_extract.train(pages, 4), html_extract.Trees)
    assert isinstance(html_extract.train(pages.where("page_id < 1000"), 4), html_extract.Names)


def test_pages_odd_cases(spark, trees):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>x"), (4, "u", "<article>" + "<p>word one, two.</p>" * 20_000), (5, "u", "<article><p>same text here, all the same.</p>"), (5, "u", "<article><p>same text here, all the same.</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("clash"), "n_chars": F.lit(-1)})
    got = html_extract.extract(pages, trees)
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == len(rows)
    by = {r.page_id: r for r in got.collect()}
    assert by[1].text == by[2].text == "" and by[4].text.count("\n\n") == 19_999 and by[5].text.startswith("same text")
    assert html_extract.extract(pages).count() == len(rows)
    assert html_extract.extract(pages.limit(0)).count() == 0
