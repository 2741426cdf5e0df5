"""The corpus operators against brute force, round trips, held-out accuracy and edge cases."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from placeloom.llm import common, decontam, embed, html, langid, license, mix, ngram_join, pii, tokens, toxicity
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, class string, component string, score string"
WORDS = [a + b for a in "ba be bi bo ka ke ki ko ma me mi mo".split() for b in "ra re ri ro ta te ti to".split()]


def table(spark, rows, schema=DOCS):
    width = len(schema.split(","))
    return spark.createDataFrame([tuple(r) + (None,) * (width - len(r)) for r in rows], schema)


def text_of(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def shingles(text, width=5, lower=True):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [text_of(rng, rng.randint(20, 120)) for _ in range(40)]
    passage = text_of(rng, 30)
    rows = []
    for t in base:
        rows += [t] * rng.choice([1, 1, 2, 3])
        w = t.split()
        for _ in range(rng.choice([0, 1, 4])):  # edits of one or more words
            v = list(w)
            for _ in range(rng.randint(1, 4)):
                v[rng.randrange(len(v))] = rng.choice(WORDS)
            rows.append(" ".join(v))
        if rng.random() < 0.4:
            rows.append(t[: len(t) // 3] + " " + passage + " " + t[len(t) // 3 :])
    rows += [None, "", "   ", "one", "one", "One", "a b c d", "a b c d", "a b c d e", text_of(rng, 6000)]
    rng.shuffle(rows)
    return [(i, t) for i, t in enumerate(rows)]


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_ngram_join_equals_brute_force(spark, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(table(spark, corpus)).collect()}
    assert got == brute_components(corpus)


def test_ngram_join_links_equal_brute_force(spark, corpus):
    docs = table(spark, corpus)
    members = {}
    for r in ngram_join.candidate_sets(docs, "text", 5)[1].collect():
        if r["class"] is not None:
            members.setdefault(r["class"], r.doc_id)
    texts, want = dict(corpus), set()
    sets = {k: shingles(texts[d]) for k, d in members.items()}
    for a, b in itertools.combinations(sorted(sets), 2):
        n = len(sets[a] & sets[b])
        if n and 100 * n >= 75 * len(sets[a] | sets[b]):
            want.add((a, b, len(sets[a]), len(sets[b]), n))
    got = [tuple(r[c] for c in ("class_a", "class_b", "size_a", "size_b", "shared")) for r in ngram_join.links(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_ngram_join_with_hot_shingles(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "_HOT", 4)
    rng = random.Random(31)
    line, rows = text_of(rng, 12), []
    for _ in range(30):
        t = text_of(rng, rng.randint(6, 50))
        rows += [f"{t} {line}", f"{t} {rng.choice(WORDS)} {line}"] if rng.random() < 0.5 else [t, f"{line} {t}"]
    rows += [line] * 5 + [f"{line} {rng.choice(WORDS)}" for _ in range(12)]
    rows = list(enumerate(rows))
    for n in (1, 3):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(table(spark, rows).repartition(n)).collect()}
        assert got == brute_components(rows)


def test_ngram_join_of_one_large_group(spark):
    rng = random.Random(9)
    w = text_of(rng, 80).split()
    rows = []
    for i in range(150):
        v = list(w)
        for _ in range(rng.randint(0, 4)):
            v[rng.randrange(len(v))] = rng.choice(WORDS)
        rows.append((i, " ".join(v)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(table(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_ngram_join_repeated_and_null_ids(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "x y"), (7, None), (None, None)]
    got = sorted(((r.doc_id, r.component_id) for r in ngram_join.jaccard_components(table(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (7, 7), (None, None)], key=str)
    assert ngram_join.jaccard_components(table(spark, [])).count() == 0


def test_word_hashes_cut_long_texts_at_spaces(monkeypatch):
    text = "Ab  cd\tEF\n" * 500
    whole = common.word_hashes(text)
    monkeypatch.setattr(common, "_PIECE", 64)
    assert (common.word_hashes(text) == whole).all() and len(whole) == 1500


def test_components_of_a_path(spark):
    n = 60
    e = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in common.components(e).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


def test_language_id_held_out_and_edges(spark):
    rng = random.Random(1)
    words = {"en": ["the", "of", "and", "thing", "ship"], "de": ["der", "die", "und", "schön", "nicht"], "fr": ["le", "les", "être", "vous", "dans"]}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(20)), k) for i, k in enumerate(list(words) * 40)]
    model = langid.train(table(spark, rows[:90]))
    edge = [(900, None), (901, ""), (902, "123 --- !!"), (903, "the of and " * 60000), (904, "und die der nicht"), (904, "und die der nicht")]
    got = langid.predict(table(spark, rows[90:] + edge), model).collect()
    truth = {i: k for i, _, k in rows}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.doc_id < 900)
    by = {r.doc_id: (r.lang_pred, r.ambiguous) for r in got}
    assert [by[i] for i in (900, 901, 902, 903, 904)] == [("und", False)] * 3 + [("en", False), ("de", False)]
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.predict(table(spark, edge), langid.train(table(spark, []))).where("lang_pred <> 'und'").count() == 0


def test_language_sample_is_bounded_and_letters_are_letters(spark):
    rows = [(i, "same text" if i % 2 else f"text {i}", f"l{i % 3}") for i in range(600)]
    got = langid._sample(table(spark, rows).select(F.col("text").alias("t"), F.col("lang").alias("l")), 20).collect()
    assert {k: len([r for r in got if r.l == k]) for k in ("l0", "l1", "l2")} == {"l0": 20, "l1": 20, "l2": 20} and len({tuple(r) for r in got}) == 60
    model = langid.train(table(spark, [(i, f"{'ab' if i % 2 else 'xy'} {i}", f"k{i % 2}") for i in range(20)] + [(30 + i, f"w{i} v{i}", f"r{i}") for i in range(230)]))
    assert len(model.classes) == 232
    assert [model.predict_one(t)[0] == "und" for t in ("½ ² 12", "Ⅷ", "é", "ª")] == [True, True, False, False]


def test_language_pieces_count_each_gram_once(monkeypatch):
    data = "abcdefg hijk " * 9
    whole = langid.features(data)
    monkeypatch.setattr(langid, "_PIECE", 16)
    cut = langid.features(data)
    assert (cut[0] == whole[0]).all() and np.allclose(cut[1], whole[1])


def test_language_codes_separate():
    for k in (2, 3, 4, 5, 8):
        m = langid.code_matrix(k)
        assert min((m[i] != m[j]).sum() for i in range(k) for j in range(i)) >= (1 if k < 3 else 2)
    mixed = langid.EcocModel(["a", "b"], langid.code_matrix(2), np.zeros((langid.DIM, 1), np.float32), np.zeros(1), np.ones((2, 1)))
    assert mixed.predict_one("abc")[2]


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p><article>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/a>A</a></ul></nav>
<div class="cookie-notice">We use cookies and the like of it.</div><article class=post><h1>Main &amp; title</h1><p><b>The first of the <i>paragraphs</i>&nbsp; is
here.<br><p>Short.</p><form><input name=q><button>Go</button></form><p>It was the best of times and it was the worst of times, which is all that there is to say of it.</p>
<div class="share">Share this</div><p>End<!-- <p>no</p> --></article><section id="comments"><p>A reader says that this is of the best.</p></section><aside>Side</aside><footer>&copy; x</footer></body></html>"""


def test_html_main_text(spark):
    want = "Main & title\n\nThe first of the paragraphs is here.\n\nShort.\n\nIt was the best of times and it was the worst of times, which is all that there is to say of it.\n\nEnd"
    assert html.main_text(PAGE) == want
    assert [html.main_text(x) for x in (None, "", "<p>", "<!-- open", "<script>x")] == [""] * 5
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (2, None, None, None)]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r.page_id, r.text, r.n_chars) for r in sorted(got, key=lambda r: r.page_id)] == [(1, want, len(want))] * 2 + [(2, "", 0)]


def test_html_without_article_uses_density():
    good = "It is the case that the house of the man was in the middle of the wood, and that it was not for him to say what was in it. " * 2
    page = f"<div><a href=x>Home</a> <a href=y>News</a></div><div><p>{good}</p><p>And so.</p><p>{good}</p></div><div>Imprint</div>"
    assert html.main_text(page) == "\n\n".join([good.strip(), "And so.", good.strip()])
    deep = "<div>" * 3000 + "<p>" + good * 30 + "</p>"
    assert html.main_text(deep) == (good * 30).strip()


def test_html_names_drop_no_article():
    body = "It was the best of times and it was the worst of times, as he said to them in the house that was on the hill. " * 3
    p, want = f"<p>{body}</p>", body.strip()
    for page in (
        f"<div class='layout has-sidebar'><article>{p}</article></div>", f"<div class='content form-page'>{p}</div>", f"<article class='post category-legal tag-social'>{p}</article>",
        f"<article class='legal'>{p}</article>", f"<div class='widget'><article>{p}</article></div>", f"<div class='notice'>{p}</div>",
    ):
        assert html.main_text(f"<html><body>{page}</body></html>") == want, page
    for name in ("related-work", "legal"):
        assert html.main_text(f"<article>{p}<section id='{name}'>{p}</section></article>") == f"{want}\n\n{want}"
    for zone in ("<div class='sidebar'>{}</div>", "<div class='site-footer'>{}</div>", "<div id='comments'><article class='comment'>{}{}{}</article></div>", "<div class='related-posts'><article>{}</article></div>", "<div class='ad'>{}</div>"):
        assert html.main_text(f"<article>{p}{p}</article>" + zone.replace("{}", "<p>" + body.replace("best", "first") + "</p>")) == f"{want}\n\n{want}", zone


_EN = "It was the best of times and it was the worst of times, as he said to them in the house that was on the hill. " * 3
_RU = "Это было в начале лета, когда они жили в доме у реки. Вечером отец читал им книгу, и все слушали молча. " * 4
_JA = "それは夏の初めのことで、彼らは川のそばの家に住んでいた。夕方になると父が本を読み、みんなは黙って聞いていた。" * 6
_EL = "Ήταν η αρχή του καλοκαιριού, όταν έμεναν στο σπίτι δίπλα στο ποτάμι. Το βράδυ ο πατέρας διάβαζε. " * 4
_MENU = "<ul><li><a href=/a>Home</a><li><a href=/b>News of the day</a><li><a href=/c>About us and the team</a></ul>"
_CARDS = "<article class='card'><a href=/x><h3>Another story</h3></a><p>Read how it went on.</p></article>"


def _p(*texts):
    return "".join(f"<p>{t}</p>" for t in texts)


#: (page, texts of the blocks of its main text): wrappers, scripts and boilerplate as they occur.
LABELLED = [
    (f"<div class='page with-sidebar'>{_p(_EN)}</div>", [_EN]), (f"<div class='container no-sidebar'><article>{_p(_EN)}</article></div>", [_EN]),
    (f"<article class='post tags'>{_p(_EN)}</article>", [_EN]), (f"<body><form action=/x>{_MENU}{_p(_EN, _EN)}<input name=q></form>", [_EN, _EN]),
    (f"<div>{_p(_EN, _EN)}</div><article class='card'><p>A teaser of the day.</p></article>", [_EN, _EN]), (f"<div>{_p(_EN, _EN)}</div>{_CARDS}", [_EN, _EN]),
    (f"<article><h1>Title</h1>{_p(_EN, _EN, _EN)}</article>{_CARDS * 3}", ["Title", _EN, _EN, _EN]), (_p(_RU), [_RU]), (_p(_JA), [_JA]), (_p(_EL, _EL), [_EL, _EL]),
    (f"<main>{_p(_RU, _JA)}</main>", [_RU, _JA]), (f"{_MENU}<div>{_p(_RU, _RU)}</div><div>{_MENU}</div>", [_RU, _RU]),
    (f"<article>{_p(_EN, 'See the <a href=/l>long list of the works of his that were read to them</a>, as it is.', _EN)}</article>", [_EN, "See the long list of the works of his that were read to them, as it is.", _EN]),
    (f"<article>{_p(_EN)}<div class='share'>Share this</div>{_p('Short.', _EN)}</article>", [_EN, "Short.", _EN]), (f"<article>{_p(_EN)}<nav>{_MENU}</nav>{_p('End')}</article>", [_EN, "End"]),
    (f"<header><h1>Site</h1></header><article><header><h1>Title</h1></header>{_p(_EN)}</article><footer>{_p(_EN)}</footer>", ["Title", _EN]),
    (f"<div id='sidebar'>{_p(_EN)}</div><article>{_p(_EN, _EN)}</article>", [_EN, _EN]), (f"<article>{_p(_EN)}</article><section id='comments'><article>{_p(_EN, _EN, _EN)}</article></section>", [_EN]),
    (f"<div class='cookie-banner'>{_p(_EN)}</div><div>{_p(_EN, _EN, _EN)}</div>", [_EN] * 3), (f"<div role='complementary'>{_p('A note.')}</div><div role='main'>{_p(_EN)}</div>", [_EN]),
    (f"<script>{_EN}</script><style>p{{}}</style><noscript>{_p(_EN)}</noscript>{_p(_EN)}", [_EN]), (f"<div hidden>{_p(_EN)}</div><div style='display: none'>{_p(_EN)}</div>{_p(_EN)}", [_EN]),
    (f"<table><tr><td>{_MENU}<td>{_p(_EN, _EN)}</table>", [_EN, _EN]), (f"<article><h2>One</h2>{_p(_EN)}<h2>Two</h2><ul><li>first<li>second</ul>{_p(_EN)}</article>", ["One", _EN, "Two", "first", "second", _EN]),
    (f"<article><blockquote>{_EN}</blockquote><pre>x = 1;\ny = 2;</pre>{_p(_EN)}</article>", [_EN, "x = 1; y = 2;", _EN]), (f"<article>{_p(_EN)}</article><article>{_p(_EN, _EN)}</article>", [_EN] * 3),
    (f"<div class='widget newsletter'><form>Sign up<input></form></div><main>{_p(_EN)}</main><aside>{_p(_EN)}</aside>", [_EN]), (f"<p>{_EN}<p>{_EN}<div>{_MENU}</div>", [_EN, _EN]),
    (f"<b><i>{_p(_EN)}</b></i></u>{_p(_EN)}", [_EN, _EN]), (f"<article>{_p(_EN.replace(' and ', ' &amp; ').replace('was', '<em>was</em>'))}</article>", [_EN.replace(" and ", " & ")]),
    (f"<div>{_MENU}</div>", []), ("<p>&nbsp; </p><footer>x</footer>", []), (f"<div class='post-content'>{_p(_EN)}<div class='tags'><a href=/t>tag</a></div></div>", [_EN]),
    (f"<div itemprop=articleBody>{_p(_EN, 'Short.')}</div>{_p('Outside.')}", [_EN, "Short."]), (f"<dialog open>{_p(_EN)}</dialog><button>{_EN}</button><select><option>{_EN}</select>{_p(_EN)}", [_EN]),
]


@pytest.mark.parametrize("case", range(len(LABELLED)))
def test_html_labelled_pages(case):
    page, want = LABELLED[case]
    assert html.main_text(f"<!DOCTYPE html><html><body>{page}</body></html>") == "\n\n".join(t.strip() for t in want)


def test_html_time_grows_with_the_page():
    import time

    for unit in ("<b>{}</i>", "<i><div><b>{}</i>", "<p><b>{}</p>", "<a>{}<div>"):
        open_tag, close_tag = unit.split("{}")
        took = []
        for n in (10_000, 40_000):
            began = time.perf_counter()
            html.main_text(open_tag * n + "x" + close_tag * n)
            took.append(time.perf_counter() - began)
        assert took[1] < 12 * took[0] + 0.5 and took[1] < 5


def test_license_scan(spark):
    notice = "Some words here.\nReleased under the MIT License.\nMore words."
    rows = [(1, notice), (1, notice), (2, license._APACHE), (3, "We released a thing under the sun."), (4, None), (5, ""), (6, "MIT"), (7, "x\n\n" + license._MIT.lower() + "\n\ny")]
    got = {(r.doc_id, r.licence, round(r.dice, 2)) for r in license.scan(table(spark, rows)).collect()}
    assert {g[:2] for g in got} == {(1, "MIT"), (2, "Apache-2.0"), (7, "MIT")}
    assert (1, "MIT", 1.0) in got and (7, "MIT", 1.0) in got
    # anchors lose nothing: what lacks them holds too few bigrams of any template
    words = set(license.anchors())
    for _, _, t in license.TEMPLATES:
        b = license.bigrams_of(t)
        assert sum(not (set(g.split()) & words) for g in b) < license.THRESHOLD / (2 - license.THRESHOLD) * len(b)


def test_license_windows_and_counts(spark):
    parts = ("Permission is hereby granted", "The above copyright notice", 'THE SOFTWARE IS PROVIDED "AS IS"')
    mit = license._MIT
    at = [mit.index(x) for x in parts]
    pasted = "\n *\n".join(" * " + mit[a:b].replace("\n", "\n * ") for a, b in zip(at, [*at[1:], len(mit)], strict=True))
    bsd = license._BSD.format(license._BSD3)
    rows = [
        (1, f"int main() {{}}\n/*\n * Copyright (c) 2020 Someone\n *\n{pasted}\n */\nint x = 1;\nreturn x;"), (2, "intro\n\n" + bsd.replace(" 2. ", "\n\n2. ").replace(" 3. ", "\n\n3. ") + "\n\nmore text"),
        (3, "Released under the MIT License. " * 100), (4, "word " * 20000 + "\nLicensed under CC BY 4.0.\n" + "word " * 20000), (5, None),
    ]
    got = {(r.doc_id, r.licence): (r.dice, r.n) for r in license.scan(table(spark, rows)).groupBy("doc_id", "licence").agg(F.max("dice").alias("dice"), F.count_if(~F.col("spans")).alias("n")).collect()}
    assert set(got) == {(1, "MIT"), (2, "BSD-3-Clause"), (3, "MIT"), (4, "CC-BY-4.0")}
    assert got[1, "MIT"][0] > 0.95 and got[2, "BSD-3-Clause"][0] == 1.0
    assert license.scan(table(spark, [])).count() == 0


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 24)).astype(np.float32)
    v[20:40] = v[:20] + rng.normal(size=(20, 24)).astype(np.float32) * rng.uniform(0.1, 0.7, size=(20, 1)).astype(np.float32)
    v[40] = v[0]
    v[41] = v[0] * 3
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)]
    rows += [(100, None, 0), (101, [0.0] * 24, 0), (102, [float("nan")] * 24, 0), (103, [None] * 24, 0), (104, [float("inf")] * 24, 0), (105, [1.0, 2.0], 0), (106, [2.0, 4.0], 0), (107, [], 0)]
    u = v.astype(float) / np.linalg.norm(v.astype(float), axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    comp = list(range(len(v)))
    for _ in range(60):
        comp = [min([comp[i], *(comp[j] for j in np.flatnonzero(link[i]))]) for i in range(len(v))]
    want = {i: (int(link[i].sum()), comp[i]) for i in range(len(v))} | {i: (0, i) for i in (100, 101, 102, 103, 104, 107)} | {105: (1, 105), 106: (1, 105)}
    for block in (7, 4096):
        got = embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), block=block).collect()
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert embed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_embeddings_dense_tiles_null_ids_and_doubt(spark, monkeypatch):
    rng = np.random.default_rng(5)
    base = rng.normal(size=32)
    near = base + rng.normal(size=(150, 32)) * 0.05  # one dense group
    edge = []  # pairs at the threshold, which codes alone cannot decide
    for k in range(40):
        a = rng.normal(size=32)
        b = rng.normal(size=32)
        a, b = a / np.linalg.norm(a), b - (a @ b) / (a @ a) * a
        b /= np.linalg.norm(b)
        c = 0.9 + (k - 20) * 1e-6
        edge += [a, c * a + np.sqrt(1 - c * c) * b]
    v = np.concatenate([near, edge])
    rows = [(None if i < 3 else i, [float(x) for x in r]) for i, r in enumerate(v)]
    u = v / np.linalg.norm(v, axis=1)[:, None]
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    got = sorted((r.vec_id or 0, r.n_links, r.component_id) for r in embed.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block=64).collect())
    want = []
    for i in range(len(v)):
        reach = {i}
        while (more := reach | {int(j) for k in reach for j in np.flatnonzero(link[k])}) != reach:
            reach = more
        want.append((0 if i < 3 else i, int(link[i].sum()), min([j for j in reach if j >= 3], default=None)))
    assert got == sorted(want)
    fold = embed.Fold(np.ones(4, dtype=np.int64))
    for i, j in (([0], [1]), ([2], [3]), ([], []), ([1, 1], [2, 3])):
        fold.add(np.array(i, dtype=int), np.array(j, dtype=int))
    assert fold.root.tolist() == [0, 0, 0, 0] and fold.links.tolist() == [1, 3, 2, 2]


def test_quantisation_bound_holds():
    rng = np.random.default_rng(0)
    unit, codes, scale, error = embed.quantise(rng.normal(size=(200, 64)))
    est = (codes.astype(float) @ codes.T.astype(float)) * np.outer(scale, scale)
    assert (np.abs(est - unit @ unit.T) <= error[:, None] + (1 + error[:, None]) * error[None, :]).all()


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 17, 1000, 4097):
        p = tokens.feistel(np.arange(n), n, 99)
        assert sorted(p) == list(range(n))
        assert (tokens.feistel(p, n, 99, inverse=True) == np.arange(n)).all()
    assert (tokens.feistel(np.arange(1000), 1000, 1) != tokens.feistel(np.arange(1000), 1000, 2)).any()


def test_token_shards_round_trip(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    rows = [(i, text_of(rng, rng.randint(0, 90))) for i in range(40)] + [(50, None), (51, ""), (52, "two  spaces\n \nand é 漢字 <|endoftext|>"), (52, "two  spaces"), (None, text_of(rng, 3000))]
    out = f"file://{tmp_path}/shards"
    kw = {"length": 64, "shard_slots": 16}
    index = sorted(tokens.materialise(table(spark, rows), out, **kw).collect(), key=lambda r: r.slot)
    n = len(index)
    assert [r.slot for r in index] == list(range(n))
    data = np.stack(list(tokens.read_slots(out, 0, n, **kw)))
    assert (np.stack(list(tokens.read_slots(out, n // 2, n, **kw))) == data[n // 2 :]).all()
    assert all(zlib.crc32(data[r.slot].tobytes()) == r.checksum for r in index)
    flat = data[tokens.feistel(np.arange(n), n, 20240229)].reshape(-1)[: sum(r.n_ids for r in index)]
    enc, ends = tokens.encoder(), np.flatnonzero(flat == tokens.END_OF_TEXT)
    got = [enc.decode(p[p != tokens.END_OF_TEXT].tolist()) for p in np.split(flat, ends + 1)[:-1]]
    assert sorted(got) == sorted(t or "" for _, t in rows)
    assert {d for r in index for d in r.doc_ids} == {d for d, _ in rows}
    assert tokens.materialise(table(spark, []), out).count() == 0
    monkeypatch.setattr(tokens, "_PIECE", 50)
    assert (tokens.encode(rows[-1][1])[:-1] == np.array(enc.encode_ordinary(rows[-1][1]))).all()


def test_token_shards_small_batches(spark, tmp_path, monkeypatch):
    """However many rows a task has, Python gets a few MB of them at once; all are laid out."""
    kind, seen, limit = type(spark.range(0)), f"{tmp_path}/seen", "spark.sql.execution.arrow.maxBytesPerBatch"
    plain, before = kind.mapInArrow, spark.conf.get(limit)

    def noted(self, run, *rest, **options):
        def each(batches):
            def note():
                for b in batches:
                    with open(seen, "a") as f:
                        f.write(f"{b.num_rows} {b.nbytes}\n")
                    yield b

            return run(note())

        return plain(self, each, *rest, **options)

    monkeypatch.setattr(kind, "mapInArrow", noted)
    rng = random.Random(3)
    long = text_of(rng, 1_000_000)  # longer than a batch: it comes alone
    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 7, F.lit(long)).otherwise(F.repeat(F.lit("abc de "), 500)).alias("text"))
    out = tokens.materialise(docs, f"file://{tmp_path}/shards").collect()
    assert sum(r.n_ids for r in out) == 2999 * len(tokens.encode("abc de " * 500)) + len(tokens.encode(long))
    batches = [tuple(map(int, x.split())) for x in open(seen)]
    assert sum(n for n, _ in batches) == 2 * 3000  # to be tokenised and to be cut
    assert max(size for n, size in batches) < len(long) + (3 << 20) and sorted(size for _, size in batches)[-3] < 3 << 20
    assert spark.conf.get(limit) == before
    spark.conf.set(limit, "4m")
    try:
        with common.small_batches(spark):
            assert spark.conf.get(limit) == "4m"
        assert spark.conf.get(limit) == "4m"
    finally:
        spark.conf.unset(limit)


def test_token_shards_resume(spark, tmp_path):
    rng = random.Random(21)
    rows = [(i, text_of(rng, rng.randint(0, 60))) for i in range(150)]
    out, kw = f"file://{tmp_path}/shards", {"length": 32, "shard_slots": 8}
    run = lambda df, **o: sorted(tokens.materialise(df, out, **kw, **o).collect(), key=lambda r: r.slot)
    first = run(table(spark, rows).repartition(3))
    bytes_of = lambda: {p.name: p.read_bytes() for p in (tmp_path / "shards").glob("shard-*.bin")}
    files = bytes_of()
    assert len(files) > 6
    names = sorted(files)
    (tmp_path / "shards" / names[0]).unlink()  # gone
    (tmp_path / "shards" / names[1]).write_bytes(files[names[1]][:-64])  # cut short
    (tmp_path / "shards" / names[2]).write_bytes(files[names[2]][:-64] + b"x" * 64)  # damaged
    (tmp_path / "shards" / f"{names[3]}.index").unlink()
    kept = {n: (tmp_path / "shards" / n).stat().st_mtime_ns for n in names[4:]}
    again = run(table(spark, list(reversed(rows))).repartition(7), resume=True)
    assert again == first and bytes_of() == files
    assert kept == {n: (tmp_path / "shards" / n).stat().st_mtime_ns for n in names[4:]}
    for wrong in (dict(permutation_key=5), dict(vocabulary="/elsewhere/other.tiktoken")):
        with pytest.raises(ValueError, match="other settings"):
            run(table(spark, rows), resume=True, **wrong)
    with pytest.raises(ValueError, match="another corpus"):
        run(table(spark, rows[1:]), resume=True)
    import shutil

    shutil.rmtree(tmp_path / "shards" / "_tokens")  # then all is written anew, and fits its own index
    anew = run(table(spark, rows).repartition(5), resume=True)
    data = np.stack(list(tokens.read_slots(out, 0, len(anew), **kw)))
    assert all(zlib.crc32(data[r.slot].tobytes()) == r.checksum for r in anew)
    assert not list((tmp_path / "shards").glob("_drafts"))
    (tmp_path / "mine").mkdir()
    (tmp_path / "mine" / "file").write_text("x")
    with pytest.raises(FileExistsError):
        tokens.materialise(table(spark, rows), f"file://{tmp_path}/mine", **kw)


def test_pii_surrogates(spark):
    t = "Mrs. Jane Smith, +1 (663) 555-6869 or +1-663-555-6869; card 4111 1111 1111 1111, a.b9@c.org, 192.168.1.20, 123-45-6789. Dr. Smith again. Mr. Bob Smith."
    rows = [(1, t), (1, t), (2, None), (3, ""), (4, "No data: 3.14.15, v1.2.3.4.5, 12 apples"), (5, "Госпожа Мария Иванова; г-н Иванова"), (6, "x " * 40000 + "a.b9@c.org")]
    got = {r.doc_id: r for r in pii.pseudonymise(table(spark, rows), "k").collect()}
    new = got[1].text
    assert not any(x in new for x in ("Jane", "Smith", "555-6869", "4111 1111", "a.b9@c.org", "192.168", "123-45"))
    phones = re.findall(r"\+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1-(\d{3})-(\d{3})-(\d{4})", new)[0]
    assert phones[:3] == phones[3:]
    last = re.findall(r"(?:Mrs\. \w+|Dr\.|Mr\. \w+) (\w+)", new)
    assert len(set(last)) == 1
    assert re.search(r"Mrs\. (\w+)", new).group(1) in pii.GIVEN["f", "latin"].split() and re.search(r"Mr\. (\w+)", new).group(1) in pii.GIVEN["m", "latin"].split()
    card = [int(c) for c in re.search(r"card ([\d ]+)", new).group(1) if c.isdigit()]
    assert sum(d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(reversed(card))) % 10 == 0
    mail = re.search(r"\S+@\S+\.example\.org", new).group(0).rstrip(",")
    assert mail in got[6].text and got[6].n_entities == 1
    assert (got[2].text, got[2].n_entities, got[3].text, got[4].text) == (None, 0, "", rows[4][1])
    assert re.fullmatch(r"Госпожа [А-Яа-яё]+ ([А-Яа-я]+); г-н \1", got[5].text)
    assert pii.pseudonymise(table(spark, []), "k").count() == 0


def test_pii_phones_keep_the_country_and_stay_distinct(spark):
    rows = [(i, f"+49 30 {1000000 + i:07d}; +355 42 {2000000 + i:07d}".replace("; ", " ; ")) for i in range(60)]
    rows = [(i, re.sub(r"(\d{3})(\d{4})", r"\1 \2", t)) for i, t in rows]
    new = [r.text for r in pii.pseudonymise(table(spark, rows), "k").collect()]
    assert all(re.fullmatch(r"\+49 \d\d \d{3} \d{4} ; \+355 \d\d \d{3} \d{4}", t) for t in new)
    assert len({x for t in new for x in t.split(" ; ")}) == 120


def test_pii_phones_in_international_and_national_layouts(spark):
    phones = ["+442079460958", "+14155552671", "+33 6 12 34 56 78", "+49 30 1234567", "+49 171 1234567", "415 555 2671", "06 12 34 56 78", "030 1234567", "(042) 35761234", "07700 900123", "0612345678", "+49 (0)30 1234567", "0049 30 1234567"]
    others = ["01.02.2024 12:30", "01234-5678", "0.123456789", "+4420794609581234567", "0-306-40615-2", "2024-01-02 03:04:05"]
    rows = [(i, f"Call {x}, please.") for i, x in enumerate(phones + others)] + [(99, "+1 (663) 555-6869 192.168.1.20")]
    got = {r.doc_id: r for r in pii.pseudonymise(table(spark, rows), "k").collect()}
    for i, x in enumerate(phones):
        new = got[i].text[5:-9]
        assert got[i].n_entities == 1 and new != x and re.sub(r"\d", "9", new) == re.sub(r"\d", "9", x)
    assert all(got[len(phones) + i].text == f"Call {x}, please." for i, x in enumerate(others))
    plain = [got[phones.index(x)].text[5:-9] for x in ("+49 30 1234567", "+49 (0)30 1234567", "0049 30 1234567")]
    assert plain[0] == plain[1].replace("(0)", "") == plain[2].replace("00", "+", 1) and plain[1].startswith("+49 (0)") and plain[2].startswith("0049 ")
    assert got[99].n_entities == 2 and "555-6869" not in got[99].text and "168" not in got[99].text
    rows = [(i, f"+49 30 {1000000 + i:07d} ; +355 42 {2000000 + i:07d}") for i in range(60)]
    new = [r.text for r in pii.pseudonymise(table(spark, rows), "k").collect()]
    assert all(re.fullmatch(r"\+49 \d\d \d{7} ; \+355 \d\d \d{7}", t) for t in new)
    assert len({x for t in new for x in t.split(" ; ")}) == 120


def test_pii_forms_cards_and_capacity(spark):
    rows = [(1, "+1 (212) 555-0100 or (212) 555-0100 or 212-555-0100 or 1-212-555-0100."), (2, "Order 12345678123456, card 1234 5678 1234 5678, 1234567812345678, 4111111111111111."), (3, "")]
    clash = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_entities int")
    got = {r.doc_id: r for r in pii.pseudonymise(clash, "k").collect()}
    digits = [re.sub(r"\D", "", x)[-10:] for x in got[1].text.split(" or ")]
    assert len(set(digits)) == 1 and digits[0] != "2125550100" and got[1].n_entities == 4
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} or \(\d{3}\) \d{3}-\d{4} or \d{3}-\d{3}-\d{4} or 1-\d{3}-\d{3}-\d{4}\.", got[1].text)
    assert "Order 12345678123456," in got[2].text and "1234 5678" not in got[2].text and "41111" not in got[2].text
    assert "1234567812345678" not in got[2].text
    other = {r.doc_id: r.text for r in pii.pseudonymise(clash, "another").collect()}
    assert other[1] != got[1].text
    ips = spark.range(3000).select(F.lit("ip").alias("type"), F.concat_ws(".", F.lit("10"), F.lit("1"), F.floor(F.col("id") / 250).cast("string"), (F.col("id") % 250 + 1).cast("string")).alias("canon"))
    assert pii.surrogates(ips, "k").select("surrogate").distinct().count() == 3000
    with pytest.raises(ValueError, match="share the space"):
        pii.surrogates(spark.range(60).select(F.lit("phone").alias("type"), F.format_string("+1%02d", "id").alias("canon")), "k")


def test_pii_neutral_titles_corefer(spark):
    rows = [(1, "Mrs. Jane Smith met Dr. Jane Smith."), (2, "Dr. Kim Lee and Prof. Kim Lee, Mr. Alex Roe, Ms. Alex Roe, Dr. Alex Roe.")]
    got = {r.doc_id: r.text for r in pii.pseudonymise(table(spark, rows), "k").collect()}
    a, b = re.fullmatch(r"Mrs\. (\w+ \w+) met Dr\. (\w+ \w+)\.", got[1]).groups()
    assert a == b and "Jane" not in a
    names = re.findall(r"(?:Dr|Prof|Mr|Ms)\. (\w+) \w+", got[2])
    assert names[0] == names[1] and len(set(names[2:])) == 3


def test_pii_whole_names_and_bare_mentions(spark):
    rows = [
        (1, "Smith came. Mrs. Jane Smith signed. Smith left, Jane Smith stayed, SMITH's too; a smith, Smithson."),
        (2, "Mr. John Q. Public met Dr. Anna Maria Schmidt, Mr. Smith-Jones, Mrs. O'Brien and Prof. Dr. J.R.R. Tolkien. O'Brien's and Jones's; John Q. Public."),
        (3, "Dr. Ludwig van Beethoven Jr. wrote. Beethoven played to Mr. X. Then rest. The end."),
        (4, "Jane Smith and Smith, untitled."),
        (5, "Mr. Thomas met Mrs. Thomas Berg; Thomas Berg saw Thomas."),
    ]
    got = {r.doc_id: r for r in pii.pseudonymise(table(spark, rows), "k").collect()}
    m = re.fullmatch(r"(\w+) came\. Mrs\. (\w+) (\w+) signed\. (\w+) left, (\w+) (\w+) stayed, (\w+)'s too; a smith, Smithson\.", got[1].text).groups()
    assert m[0] == m[2] == m[3] == m[5] == m[6].title() != "Smith" and m[1] == m[4] != "Jane" and got[1].n_entities == 5
    m = re.fullmatch(r"Mr\. (\w+ \w\. \w+) met Dr\. \w+ \w+ \w+, Mr\. \w+-(\w+), Mrs\. (\w+) and Prof\. Dr\. \w\.\w\.\w\. \w+\. (\w+)'s and (\w+)'s; (\w+ \w\. \w+)\.", got[2].text).groups()
    assert m[0] == m[5] and m[2] == m[3] and m[1] == m[4]
    assert not any(x in got[2].text for x in ("John", " Q.", "Public", "Anna", "Maria", "Schmidt", "Smith", "Jones", "Brien", "J.R.R", "Tolkien")) and got[2].n_entities == 8
    m = re.fullmatch(r"Dr\. \w+ van (\w+) Jr\. wrote\. (\w+) played to Mr\. X\. Then rest\. The end\.", got[3].text).groups()
    assert m[0] == m[1] != "Beethoven"
    assert (got[4].text, got[4].n_entities) == (rows[3][1], 0)
    m = re.fullmatch(r"Mr\. (\w+) met Mrs\. (\w+ \w+); (\w+ \w+) saw (\w+)\.", got[5].text).groups()
    assert m[1] == m[2] and m[0] == m[3] and m[0] not in m[1]


def test_pii_surrogates_are_distinct(spark):
    e = spark.createDataFrame([("given_f_latin", f"name{i}") for i in range(120)] + [("surname_latin", f"n{i}") for i in range(300)] + [("given_f_latin", "anna"), ("ip", "1.2.3.4")], "type string, canon string")
    rows = pii.surrogates(e, "k").collect()
    assert len(rows) == 422
    for kind in ("given", "surname"):
        s = [r.surrogate.lower() for r in rows if r.type.startswith(kind)]
        assert len(set(s)) == len(s) and not set(s) & {r.canon for r in rows if r.type.startswith(kind)}


def brute_contained(docs, items):
    def sh(t):
        w = [x for x in re.split(r"[^\w]|_", (t or "").lower()) if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    out = set()
    for d, t in docs:
        for i, q in items:
            a, b = sh(t), sh(q)
            if b and 100 * len(a & b) >= 75 * len(b):
                out.add((d, i))
    return out


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(4)
    items = [(i, text_of(rng, n)) for i, n in enumerate([6, 9, 20, 60, 200, 30, 12])] + [(20, "one two"), (21, None), (22, ""), (23, text_of(rng, 20))] * 2
    docs = [(i, text_of(rng, 50)) for i in range(20)]
    for k, (i, t) in enumerate(items[:7]):
        docs.append((100 + k, text_of(rng, 400) + ", " + t.upper().replace(" ", " - ") + ". " + text_of(rng, 400)))
        w = t.split()
        docs.append((200 + k, text_of(rng, 30) + " " + " ".join(w[: int(len(w) * 0.85)])))
        docs.append((300 + k, " ".join(w[: len(w) // 2]) + " " + text_of(rng, 30)))
    docs += [(400, "One, two!"), (401, "one two three"), (402, None), (403, ""), (404, text_of(rng, 8000) + " " + items[3][1]), (404, "other text")]
    m = decontam.matches(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in m.collect()} == brute_contained(docs, items)
    left = decontam.decontaminate(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    bad = {d for d, _ in brute_contained(docs, items)}
    assert left.columns == table(spark, []).columns
    assert sorted(r.doc_id for r in left.collect()) == sorted([d for d, _ in docs if d not in bad] + [404])
    assert decontam.matches(table(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0


def water_fill(sizes, share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
        free -= over
    return target


def test_mix_targets_and_copies(spark):
    rng = random.Random(6)
    rows = [(i, text_of(rng, rng.randint(1, 40)), None, rng.choice(["hot"] * 5 + ["a", "b", "c", "d", None, "é"])) for i in range(900)] + [(1000, None, None, "a"), (1001, "", None, "z"), (5, "again", None, "a"), (5, "again", None, "a")]
    d = table(spark, rows)
    got = mix.mix(d).collect()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water_fill(sizes)
    taken = {}
    for r in got:
        assert abs(r["_mix_target"] - want[r["source"]]) < 1e-6 and r["_mix_copies"] in (0, 1, 2)
        taken[r["source"]] = taken.get(r["source"], 0) + r["_mix_size"] * r["_mix_copies"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(0.15 * t, 120)
    out = mix.emit(d)
    assert out.columns == d.columns and out.count() == sum(r["_mix_copies"] for r in got)
    assert sorted(map(str, mix.mix(d).collect())) == sorted(map(str, got))
    assert mix.mix(table(spark, [])).count() == 0


def test_mix_and_decontamination_keep_columns_of_any_name(spark):
    rows = [(i, f"w{i} a b c d e", "hot" if i % 3 else None, 7, i) for i in range(30)] + [(None, None, None, 1, 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, _mix_size int, _bad_id long")
    out = mix.emit(d)
    assert out.columns == d.columns and {r["_mix_size"] for r in out.collect()} <= {7, 1}
    left = decontam.decontaminate(d, spark.createDataFrame([(1, "w4 a b c d e"), (2, "w4 a b c d e")], "item_id long, text string"))
    assert left.columns == d.columns and left.count() == 30 and left.where("doc_id = 4").count() == 0
    best = decontam.flag(d, spark.createDataFrame([(2, "w4 a b c d e"), (1, "w4 a b c d e")], "item_id long, text string")).first()
    assert (best.item_id, best.n_items) == (1, 2)
    assert decontam.decontaminate(d.limit(0), spark.createDataFrame([(1, "x")], "item_id long, text string")).count() == 0


def test_toxicity(spark):
    rng = random.Random(8)
    toxic = ["idiot", "scum", "zorbwit"]
    rows, labels = [], []
    for i in range(400):
        w = text_of(rng, 30).split()
        bad = i % 4 == 0
        if bad:
            for t in rng.sample(toxic, 2):
                w.insert(rng.randrange(len(w)), t)
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad) if rng.random() > 0.03 else 1 - int(bad)))
    lab = spark.createDataFrame([*labels, (7, None), (9999, 1)], "doc_id long, toxic int")
    d = table(spark, rows)
    model = toxicity.train(d.where("doc_id < 300"), lab.where("doc_id < 300"))
    assert b"zorbwit" in model.learned
    edge = [(500, None), (501, ""), (502, "You st0pid IDIOT!"), (503, "zorbwit " * 50000), (504, "!!!")]
    got = toxicity.predict(table(spark, rows[300:] + edge), model).collect()
    by = {r.doc_id: r for r in got}
    assert all(by[i].predicted == (i % 4 == 0) for i in range(300, 400))
    assert [by[i].predicted for i in (500, 501, 502, 503, 504)] == [0, 0, 1, 1, 0]
    assert all(0 <= r.score <= 1 for r in got)
    bare = toxicity.train(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.predict(table(spark, [(1, "you idiot"), (2, "nice day")]), bare).where("predicted = 1").count() == 1


def test_toxicity_learns_from_unlabelled_rows_and_not_from_copies(spark):
    rng = random.Random(18)
    rows, labels = [], []
    copied = text_of(rng, 25)  # one toxic text in many near copies
    for i in range(600):
        w = text_of(rng, 30).split()
        if i % 4 == 0:
            w.insert(rng.randrange(30), rng.choice(["zorbwit", "idiot"]))
            w.insert(rng.randrange(30), "grumfel")  # never labelled on its own
        rows.append((i, f"{copied} zorbwit {i}" if i % 20 == 0 else " ".join(w)))
        if i % 3 == 0 or i % 20 == 0:
            labels.append((i, int(i % 4 == 0)))
    d, lab = table(spark, rows + rows[:50]), spark.createDataFrame(labels * 2, "doc_id long, toxic int")
    model = toxicity.train(d, lab)
    assert b"zorbwit" in model.learned and not {w.encode() for w in copied.split()} & model.learned
    assert abs(model.label_model.prior - 0.25) < 0.06  # the corpus' own rate, not that of the labelled sample
    got = toxicity.predict(table(spark, rows), model).collect()
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in got) > 590
    assert toxicity.predict(table(spark, []), toxicity.train(table(spark, []), lab)).count() == 0
    several = toxicity.train(d, spark.createDataFrame([(i, t) for i, y in labels for t in {0, y}], "doc_id long, toxic int"))
    assert several.learned == model.learned


def test_label_model_learns_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    v = np.column_stack([np.where(rng.random(4000) < acc, y, ~y) * 2 - 1 for acc in (0.95, 0.8, 0.55)])
    v = np.column_stack([v, v[:, 2]])  # the weak voter twice: correlated
    m = toxicity.fit_label_model(v)
    assert ((m.posterior(v) > 0.5) == y).mean() > ((v.sum(1) > 0) == y).mean() + 0.05  # better than a plain vote
    right = [m.when[j, 2, 1] * m.prior + m.when[j, 0, 0] * (1 - m.prior) for j in range(4)]
    assert right[0] > right[1] > right[2]
    assert m.discount[3] < 0.7 < m.discount[0]
    few = slice(0, 300)  # labelled rows as a prior
    m = toxicity.fit_label_model(v[300:], (v[few][~y[few]], v[few][y[few]]))
    right = [m.when[j, 2, 1] * m.prior + m.when[j, 0, 0] * (1 - m.prior) for j in range(4)]
    assert abs(right[0] - 0.95) < 0.06 and abs(right[1] - 0.8) < 0.06


def test_pipeline_equals_brute_force(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(12)
    langs = {"en": ["the", "of", "and", "thing", "ship", "than"], "de": ["der", "die", "und", "schön", "nicht", "wald"]}
    rows = []
    for i in range(120):
        k = "en" if i % 3 else "de"
        rows.append((i, " ".join(rng.choice(langs[k]) + rng.choice(["a", "b", "c", "d", ""]) for _ in range(40)), k, f"s{i % 4}", 0))
    rows += [(200 + i, *rows[i][1:]) for i in range(10)] + [(300, None, "en", "s0", 0), (301, "12 34 --", "en", "s1", 0)]
    item = rows[50][1]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = common.read(spark, str(tmp_path), "documents")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, str(tmp_path)), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        seen.append(sorted(r.doc_id for r in docs.collect()))
    first = [d for d, *_ in rows if d < 300]
    assert seen[0] == sorted(first)
    comp = brute_components([(d, t) for d, t, *_ in rows if d < 300])
    assert seen[1] == [d for d in sorted(first) if comp[d][1] == d]
    bad = {d for d, _ in brute_contained([(d, t) for d, t, *_ in rows if d in seen[1]], [(1, item)])}
    assert seen[2] == [d for d in seen[1] if d not in bad] and bad
    assert set(seen[3]) <= set(seen[2]) and max(seen[3].count(d) for d in seen[3]) <= 2
    out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert sum(r.n_ids for r in out) == sum(len(tokens.encode(r.text)) for r in docs.collect())
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(out)


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    schema = "doc_id long, text string, lang string, source string, n_chars long, _id long, _text string, component long"
    a, b = "one two three four five six seven", "other words that are not like the first ones at all"
    rows = [(4, a), (1, a), (4, b), (4, b), (None, a), (7, None), (7, None), (8, ""), (9, "x"), (9, "x"), (None, "y z")]
    d = spark.createDataFrame([(i, t, "en", None, 0, 5, "clash", 6) for i, t in rows], schema)
    kept = corpus_pipeline.one_of_each_group(spark, d, str(tmp_path))
    assert kept.columns == d.columns and {r["_text"] for r in kept.collect()} == {"clash"}
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert got == sorted([(1, a), (4, b), (7, None), (7, None), (8, ""), (9, "x"), (None, "y z")], key=str)
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, a)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, d, str(tmp_path)).columns == d.columns and stage(spark, d.limit(0), str(tmp_path)).count() == 0
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/empty/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
