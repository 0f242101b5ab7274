"""Toxicity, quality, language scores, HTML and the pipeline."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ctxspark.llm import html, language, quality, queries, toxicity

FOLDER = "/root/testdata/sf0.01"


def auc(y, s):
    order = sorted(range(len(s)), key=lambda k: s[k])
    rank = {k: n for n, k in enumerate(order)}
    n1 = sum(y)
    return (sum(rank[k] for k in range(len(y)) if y[k]) - n1 * (n1 - 1) / 2) / (n1 * (len(y) - n1))


def awkward(spark):
    return spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "same text", "x"), (3, "same text", "x"), (None, "no id", "x"), (5, "w" * 300_000 + " tail", "x"), (6, "😀\x00é", "x")], "doc_id long, text string, score string")


# --- toxicity ---


def test_toxicity_on_held_out_rows(spark):
    rows = toxicity.op2_toxicity(spark, FOLDER).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    own = [r for r in rows if r.held_out and r.doc_id in labels]
    y, s = [labels[r.doc_id] for r in own], [r.score for r in own]
    assert auc(y, s) > 0.85
    said = [labels[r.doc_id] for r in own if r.predicted]
    assert said and sum(said) / len(said) > 0.85
    assert len(rows) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_toxicity_without_labels_and_on_awkward_rows(spark):
    docs = awkward(spark)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()} == {0.5}
    one = spark.createDataFrame([(3, 1), (2, 1), (1, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, one)
    assert {r.score for r in toxicity.score(docs, model).collect()} == {1.0}
    few = spark.createDataFrame([(3, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.fit(docs, few)).count() == 7
    assert toxicity.remove_toxic(docs, model).columns == docs.columns and toxicity.remove_toxic(docs, model).count() == 0


def test_windows_hold_every_letter_and_digit():
    assert toxicity.words_of("A b2 f4g, x_y") == ["a", "b2", "f4g", "x", "y"]
    run = "".join(chr(0x4E00 + k) for k in range(61))
    got = toxicity.words_of(f"ab {run} cd")
    assert got[0] == "ab" and got[-1] == "cd" and {len(w) for w in got[1:-1]} == {toxicity.LONGEST}
    half = toxicity.LONGEST // 2
    assert all(any(run[k : k + half] in w for w in got) for k in range(len(run) - half + 1))
    assert toxicity.words_of("x" * 24) == ["x" * 24] and toxicity.words_of("") == []


def test_dictionaries_are_brute_force(spark):
    rows = [("calm", 9, 1), ("river", 7, 0), ("single", 1, 0), ("vileword", 1, 8), ("fouler", 0, 6), ("rarefoul", 0, 3), ("clearly", 5, 4)]
    ordinary, toxic = toxicity.dictionaries(spark.createDataFrame(rows, "w string, n0 long, n1 long"), 12)
    known = sorted((r for r in rows if r[1] and r[1] + r[2] >= 2), key=lambda r: (-r[1], r[0]))
    assert ordinary == toxicity.content([r[0] for r in known], toxicity.ORDINARY_BYTES)
    cost = toxicity.compressor(ordinary).compress
    heavy = [r for r in rows if r[2] >= 4 and len(cost(toxicity.spelled(r[0]))) >= toxicity.KNOWN_COST + toxicity.HARD]
    assert toxic == toxicity.content([r[0] for r in sorted(heavy, key=lambda r: (-r[2], r[0]))], toxicity.TOXIC_BYTES)
    assert b"fouler" in toxic and b"rarefoul" not in toxic and b"single" not in ordinary


def test_scores_are_a_loop_over_windows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 60")
    model = toxicity.fitted(spark, FOLDER)
    a, b = toxicity.compressor(model.ordinary), toxicity.compressor(model.toxic)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.score(docs, model).collect():
        d = []
        for w in toxicity.words_of(texts[r.doc_id] or ""):
            s = toxicity.spelled(w)
            d.append((len(a.compress(s)) - len(b.compress(s))) / len(s) ** 0.5)
        top, n = sorted(d)[-5:], sum(x >= model.cut for x in d)
        f = [np.log1p(n), min(20 * n / len(d), 3.0), max(top[-1], 0), max(sum(top[-3:]) / len(top[-3:]), 0), np.log1p(n) * min(10 * n / len(d), 1.0)] if d else [0] * 5
        z = sum(x * w for x, w in zip(f, model.weights, strict=False)) + model.weights[-1]
        assert abs(r.score - 1 / (1 + np.exp(-z))) < 1e-9 and (r.n_windows, r.n_toxic_windows) == (len(d), n)


def test_known_words_compress_well():
    c = toxicity.compressor(toxicity.content(["idiot", "clown"], 4000))
    assert len(c.compress(toxicity.spelled("clown"))) < len(c.compress(toxicity.spelled("zebra")))


# --- quality ---


def test_label_model_finds_accuracies():
    r = np.random.default_rng(3)
    truth = r.random(20_000) < 0.7
    accuracy = np.array([0.95, 0.9, 0.8, 0.75, 0.6])
    v = np.where(r.random((20_000, 5)) < accuracy, truth[:, None], ~truth[:, None]) * 2 - 1
    v[r.random(v.shape) < 0.2] = 0
    patterns, counts = np.unique(v, axis=0, return_counts=True)
    model = quality.estimate(patterns, counts)
    assert abs(model.prior - 0.7) < 0.03 and np.abs(model.accuracies() - accuracy).max() < 0.04


def test_quality_scores(spark):
    rows = quality.op4_quality(spark, FOLDER).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    own = [r for r in rows if r.doc_id in labels]
    assert len(rows) == 1000 and auc([labels[r.doc_id] for r in own], [r.score for r in own]) > 0.85


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = quality.score(docs, quality.fit(docs)).collect()
    assert len(rows) == 7 and all(0 <= r.score <= 1 for r in rows)
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0))).collect() == []


def test_quality_looks_at_word_pairs():
    a, b = (dict(zip(*(x.tolist() for x in quality.hashed(t)), strict=True)) for t in ("one two three four five six", "one three two five four six"))
    assert len(a) == 6 + 5 + 7 and len(set(a) & set(b)) == 6 + 7  # words and shape alike, no pair in common


def test_training_takes_one_row_of_an_id(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"text number {k} of an id that many rows share") for k in range(200)] + [(2, "another text"), (3, None)], "doc_id long, text string")
    seen, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda rows, target: seen.append(len(rows)) or train(rows, target))
    quality.fit(docs)
    assert seen == [3]
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, toxic int")
    got = toxicity._sample(labels, docs, "doc_id", "text", "toxic", None, 10).collect()
    assert sorted((r.k, r.y, r.part) for r in got) == [(1, 1, 1), (2, 0, 1)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 41)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(1, 41)], "doc_id long, text string")
    got = toxicity._sample(labels, docs, "doc_id", "text", "toxic", None, 100).collect()
    assert sorted((r.part, r.y) for r in got) == [(0, 0)] * 15 + [(0, 1)] * 15 + [(1, 0)] * 5 + [(1, 1)] * 5
    empty = docs.where("false")
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


# --- language ---


def test_probabilities_sum_to_one():
    w = language.Weights.fresh()
    line, at = language.joined([np.array([3, 4, 5, 6, 7])])
    total = 0.0
    for k in range(language.SIZE):
        other = line.copy()
        other[at[2]] = k
        total += math.exp(language.log_probabilities(w, other, at[2:3])[0])
    assert total == pytest.approx(1, abs=1e-5)


def test_gradient_is_the_numeric_one():
    w = language.Weights.fresh()
    line, at = language.joined([np.arange(1, 30)])
    loss = lambda v: -language.log_probabilities(language.Weights.of(v), line, at).mean()
    t = language.Trainer(language.Weights.of(w.vector()), rate=1.0)
    for s in t.seen:
        s[...] = 0
    before = w.vector().astype(float)
    t.seen = [np.full(s.shape, 1e12, np.float32) for s in t.seen]
    t.rate = 1e6  # one step is then the negative gradient
    t.learn(line, at)
    step = before - t.w.vector()
    r = np.random.default_rng(1)
    for k in r.choice(np.flatnonzero(np.abs(step) > 1e-3), 12, replace=False):
        a, b = before.copy(), before.copy()
        a[k] += 1e-2
        b[k] -= 1e-2
        assert step[k] == pytest.approx((loss(a) - loss(b)) / 2e-2, abs=2e-3)


def test_path_probabilities_sum_to_one():
    r = np.random.default_rng(5)
    tree = language.Tree.of([900, 300, 80, 80, 7, 1, 0, 40], 20)  # the last leaf has 21 ids
    w = language.Weights.fresh(tree=tree)
    w.out[...] = r.standard_normal(w.out.shape)
    line, at = language.joined([np.array([3, 28, 5, 8, 7])])
    for place in at:
        other = np.repeat(line[None], 8, 0)
        other[:, place] = np.arange(1, 9)
        got = [language.log_probabilities(w, x, np.array([place]))[0] for x in other]
        assert np.exp(got).sum() == pytest.approx(1, abs=1e-5) and len({round(g, 4) for g in got}) == 8


def test_spelled_words_sum_to_one():
    import itertools

    spelled = language.Speller({" a": 9, "ab": 6, "b ": 8, "a ": 3, " b": 2}, {"a": 9, "b": 9, " ": 11}, ["ab"])
    total = sum(math.exp(spelled("".join(x))) for n in range(1, 15) for x in itertools.product("ab", repeat=n) if x != ("a", "b"))
    assert 0.99 < total <= 1


def test_words_are_spelled_together_as_one_by_one(monkeypatch):
    words = ["a", "Ünï", "日本", "x\x00y", "\U0001f600b", "q" * 300, "ab", "b" * 256]
    pairs = Counter()
    for w, n in zip(words, range(1, 9), strict=True):
        s = f" {w} "
        for x, y in zip(s, s[1:], strict=False):
            pairs[x + y] += n
    assert language._pair_counts(tuple(words), tuple(range(1, 9))) == pairs
    singles = Counter()
    for p, n in pairs.items():
        singles[p[1]] += n
    asked = [*words, "never", "日a", "\U0010ffff", *(f"a{chr(k)}" for k in range(97, 400))]
    for square, together in ((1000, 10_000), (2, 3), (0, 1)):
        monkeypatch.setattr(language, "SQUARE", square)
        monkeypatch.setattr(language, "WORDS_TOGETHER", together)
        spelled = language.Speller(dict(pairs), dict(singles), ["ab"])
        assert spelled.of(asked) == pytest.approx([spelled(w) for w in asked], abs=1e-9)
        assert spelled.of(asked).tolist() == spelled.of(asked).tolist()
    assert len(language.Speller({}, {}, [""]).of(["a", "bc"])) == 2 and len(spelled.of([])) == 0


def test_values_of_texts_are_those_of_their_words(monkeypatch):
    spelled = language.Speller({" a": 9, "ab": 6, "b ": 8, "a ": 3, " b": 2}, {"a": 9, "b": 9, " ": 11}, ["the"])
    texts = ["The ab THE ba", None, "", "ab\u2003abba zoë", " the ", "b"]
    want = []
    for t in texts:
        own = (t or "").lower().split()
        want.append([(1 if w == "the" else 2 + xxhash.xxh3_64_intdigest(w.encode()) % language.CLASSES, 0.0 if w == "the" else float(np.float32(spelled(w)))) for w in own])
    monkeypatch.setattr(language.Speller, "__call__", None)  # no word is spelled on its own
    for size in (1, 3, 100):
        monkeypatch.setattr(language, "BLOCK", size)
        held = list(language.Vocabulary(["the"], spelled).blocks(texts))
        got = [v for part in held for v in part]
        assert [(v & 0xFFFFFFFF).tolist() for v in got] == [[n for n, _ in own] for own in want]
        assert [x for v in got for x in language.Vocabulary.spelled(v).tolist()] == pytest.approx([x for own in want for _, x in own], rel=1e-6)


def test_every_word_has_a_probability_of_its_own(spark):
    import xxhash

    seen, pair = {}, None
    for k in range(100_000):  # two words that hash alike
        h = xxhash.xxh3_64_intdigest(f"rare{k}".encode()) % (31 * language.CLASSES)
        if h in seen:
            pair = (f"rare{seen[h]}", f"rare{k}")
            break
        seen[h] = k
    common = [f"word{k}" for k in range(300)]
    text = " ".join(w for k, w in enumerate(common) for _ in range(1 + k % 3))
    docs = spark.createDataFrame([(k, text) for k in range(40)] + [(50, f"one {pair[0]} two"), (51, f"one {pair[1]} two {pair[1]}")], "doc_id long, text string")
    model = language.fit(docs)
    assert set(common) <= set(model.frequent)
    asked = [(k, f"word1 word2 {w} word4 word5") for k, w in enumerate([*pair, *common])]
    got = [r.log_likelihood for r in language.score(spark.createDataFrame(asked, docs.schema), model).collect()]
    assert abs(got[0] - got[1]) > 1e-3 and len({round(g, 5) for g in got}) > 290


def test_scores_prefer_the_corpus_order(spark):
    docs = spark.createDataFrame([(k, "the cat sat on the mat and the dog ran to the old house by the sea " * 6) for k in range(60)], "doc_id long, text string")
    model = language.fit(docs)
    words = docs.first().text.split()
    random.Random(2).shuffle(words)
    got = {r.doc_id: r.mean_log_likelihood for r in language.score(docs.limit(1).unionByName(spark.createDataFrame([(99, " ".join(words))], docs.schema)), model).collect()}
    assert min(v for k, v in got.items() if k != 99) > got[99]


def test_language_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(language, "SHARD", 3000)
    r = random.Random(5)
    words = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(r.choices(words, k=r.randrange(1, 90)))) for k in range(700)] + [(1000 + k, "one text that many hold " * 9) for k in range(300)] + [(2000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = {}
    for parts in (1, 3, 37):
        dealt = docs.repartition(parts)
        own[parts] = {x.doc_id: x.log_likelihood for x in language.score(dealt, language.fit(dealt)).collect()}
    assert len({round(v, 2) for v in own[1].values()}) > 500
    for parts in (3, 37):
        assert max(abs(v - own[parts][k]) / (1 + abs(v)) for k, v in own[1].items()) < 1e-4


def test_language_of_awkward_rows(spark):
    docs = awkward(spark)
    got = {r.doc_id: r for r in language.score(docs, language.fit(docs)).collect()}
    assert got[1].n_tokens == 0 and got[1].log_likelihood == 0 and got[1].mean_log_likelihood is None and got[5].n_tokens == 2
    assert language.score(docs.limit(0), language.fit(docs.limit(0))).collect() == []


# --- html ---

CASES = [
    (None, ""), ("", ""), ("just  text &amp; more", "just text & more"), ("<p>a<p>b", "a\nb"),
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><a>Home</a></nav><article><h1>H</h1><p>One <b>two</b>\n three.<br>four<p>five</article><footer>f</footer></body></html>", "H\nOne two three. four\nfive"),
    ("<body><div class='top-menu'><a>x</a></div><div><p>Long enough prose that is the text of this page.</p><p>More of it, &eacute;t&#233;.</p></div><div id='comments'><p>nice</p></div></body>", "Long enough prose that is the text of this page.\nMore of it, été."),
    ("<article><p>a</p><script>var t='</p><p>x</p>';</script><form><p>f</p></form><aside>s</aside><p>b</p></article>", "a\nb"),
    ("<body><div class='content with-sidebar'><p>The text of this page is here.</p></div><div class='sideBar'>no</div></body>", "The text of this page is here."),
    ("<article><ul><li>one<li>two</ul><table><tr><td>c<td>d</table></article>", "one\ntwo\nc\nd"),
    ("<article><p>1 < 2 and <!-- <p>no</p> -->3 > 2</p></article>", "1 < 2 and 3 > 2"),
]


@pytest.mark.parametrize(("page", "text"), CASES)
def test_main_text(page, text):
    assert html.main_text(page) == text


PROSE = [f"Paragraph {k} of the article has enough plain words to be the text of a page." for k in range(6)]


@pytest.mark.parametrize("wrapper", ["class='layout sidebar-right'", "class='sidebar-left-layout'", "class='elementor-widget'", "class='social-post'", "class='related-content'", "id='discussion'"])
def test_hint_words_on_the_wrapper_of_an_article(wrapper):
    prose = "".join(f"<p>{p}</p>" for p in PROSE)
    beside = "<div class='sidebar'><p>Beside it.</p></div><div class='widget'><a href='/1'>more of this</a><a href='/2'>and this</a></div>"
    for inner in (prose, f"<article>{prose}</article>", f"<main><h1>Head</h1>{prose}</main>"):
        head = ["Head"] if "<h1>" in inner else []
        assert html.main_text(f"<body><div {wrapper}>{inner}{beside}</div></body>") == "\n".join(head + PROSE)


def test_an_article_in_hinted_pieces():
    names = ["widget", "social", "related", "promo", "notice", "toc"]
    page = "".join(f"<div class='{n}'><p>{p}</p></div>" for n, p in zip(names, PROSE, strict=True))
    assert html.main_text(f"<body>{page}<div class='menu'><a>a</a><a>b</a></div></body>") == "\n".join(PROSE)
    page = "".join(f"<div class='elementor-widget'><p>{p}</p></div>" for p in PROSE)
    assert html.main_text(f"<body><article>{page}<div class='ad'>Buy</div></article></body>") == "\n".join(PROSE)


def test_many_comments_beside_an_article():
    prose, comments = "".join(f"<p>{p}</p>" for p in PROSE), "".join(f"<p>Comment {k} of a reader who writes at length.</p>" for k in range(12))
    assert html.main_text(f"<body><article>{prose}</article><div id='comments'>{comments}</div></body>") == "\n".join(PROSE)


@pytest.mark.parametrize("n", [1, 6, 12, 18, 24, 40, 400])
def test_comments_go_however_many(n):
    """The article and nothing else, beside or around its comments."""
    line = "This reader writes about as much as that: some sixty letters"
    prose = "".join(f"<p>{p}</p>" for p in PROSE)
    plain, nested, single = (
        "<div id='comments'>" + "".join(f"<p>{line} {k}.</p>" for k in range(n)) + "</div>",
        "<section class='comments'><ul>" + "".join(f"<li class='comment'><div>{line} {k}.</div></li>" for k in range(n)) + "</ul></section>",
        "".join(f"<div class='comment-body reply'>{line} {k}.</div>" for k in range(n)),
    )
    pages = [f"<body><{e}>{prose}</{e}>{comments}</body>" for e in ("article", "div", "main") for comments in (plain, nested, single)]
    pages += [f"<body><article>{prose}{comments}</article></body>" for comments in (plain, nested, single)]
    pages += [f"<body><div class='post comments-open'><div>{prose}</div>{comments}</div></body>" for comments in (plain, nested)]
    pages += [f"<body><main><article>{prose}</article>" + "".join(f"<article class='comment'>{line} {k}.</article>" for k in range(n)) + "</main></body>"]
    for page in pages:
        assert html.main_text(page) == "\n".join(PROSE), page[:300]


def test_a_page_that_is_a_discussion():
    prose = "".join(f"<p>{p}</p>" for p in PROSE)
    assert html.main_text(f"<body><h1>Head</h1><div id='discussion'>{prose}</div></body>") == "\n".join(["Head", *PROSE])


def test_lists_of_links_in_an_article():
    links = "".join(f"<li><a href='/{k}'>Another story, number {k}</a></li>" for k in range(8))
    prose = "".join(f"<p>{p}</p>" for p in PROSE)
    assert html.main_text(f"<body><article>{prose}<div><ul>{links}</ul></div></article></body>") == "\n".join(PROSE)
    assert html.main_text(f"<body><main><article>{prose}</article><div><ul>{links}</ul></div></main></body>") == "\n".join(PROSE)


LINKS = "<div>" + " ".join(f"<a href='/{k}'>Link {k}</a>" for k in range(8)) + "</div>"
TEXT = "".join(f"<p>{p}</p>" for p in PROSE)
UNNAMED = [
    f"<body>{LINKS}<div>Buy this thing.</div><div>{TEXT}</div><div>(c) The owner.</div></body>",
    f"<body><div>{LINKS}<div>Buy this thing.</div><div>{TEXT}</div><div>(c) The owner.</div></div></body>",
    f"<body>{LINKS}<div><div>{TEXT[:249]}</div><div>{TEXT[249:]}</div></div><div>Buy this thing.</div></body>",
    f"<body><table><tr><td>{LINKS}</td><td>{TEXT}</td></tr></table></body>",
    f"<body><div>{''.join(f'<div>Teaser {k}</div>' for k in range(40))}</div><div>{TEXT}</div></body>",
]


@pytest.mark.parametrize("page", UNNAMED)
def test_pages_without_article_or_telling_classes(page):
    assert html.main_text(page) == "\n".join(PROSE)


def test_densities_decide(monkeypatch):
    real = html.measure

    def flat(root):
        nodes, body = real(root)
        for n in nodes:
            n.density = 1.0
        for n in nodes:
            n.total = float(len(n.nodes()))
        return nodes, body

    monkeypatch.setattr(html, "measure", flat)
    assert not any(html.main_text(page) == "\n".join(PROSE) for page in UNNAMED)


def plain_densities(node):
    """(characters, tags, link characters, link tags) by the definition, each node's subtree walked anew."""
    chars = tags = link_chars = link_tags = 0
    stack = [(p, node.name == "a") for p in node.parts]
    while stack:
        p, link = stack.pop()
        if type(p) is str:
            n = len(re.sub(r"\s+", "", p))
            chars += n
            link_chars += n if link else 0
        else:
            tags += 1
            link_tags += p.name == "a"
            stack += [(q, link or p.name == "a") for q in p.parts]
    return chars, tags, link_chars, link_tags + (node.name == "a")


@pytest.mark.parametrize("page", [*UNNAMED, *(page for page, _ in CASES[3:])])
def test_densities_are_those_of_the_definition(page):
    import math

    nodes, body = html.measure(html.parse(page))
    share = plain_densities(body)[2] / max(plain_densities(body)[0], 1)
    for n in nodes:
        c, t, lc, lt = plain_densities(n)
        assert (n.chars, n.tags, n.link_chars) == (c, t, lc)
        t, lc1, lt = max(t, 1), max(lc, 1), max(lt, 1)
        want = c / t * math.log(max(c / lc1 * t / lt, 1) + 1) / math.log(math.log(c / max(c - lc, 1) * lc + share * c + math.e) + 1) if c else 0
        assert n.density == pytest.approx(want)
        assert n.total == pytest.approx(sum(p.density for p in n.parts if type(p) is not str))


def test_parts_that_only_look_like_menus():
    assert html.main_text(f"<body><form><article>{TEXT}</article></form></body>") == "\n".join(PROSE)
    assert html.main_text(f"<body><form><div>{TEXT}</div><input name='q'></form></body>") == "\n".join(PROSE)
    assert html.main_text(f"<body><div class='social-studies'>{TEXT}</div></body>") == "\n".join(PROSE)
    assert html.main_text(f"<body><div id='content' class='menu-open'>{TEXT}</div></body>") == "\n".join(PROSE)
    assert html.main_text(f"<body><article>{TEXT[:249]}<section class='related-work'>{TEXT[249:]}</section></article></body>") == "\n".join(PROSE)
    assert html.main_text(f"<body><article>{TEXT}<form><p>Your name</p></form></article></body>") == "\n".join(PROSE)


@pytest.mark.parametrize("start", ["<div>", "<div></p>", "<p><button><div>", "<b><p>", "<li><div>", "<div class='menu'>", "<table><tr><td>"])
def test_time_is_in_proportion_to_nesting(start):
    import time

    def seconds(n):
        began = time.process_time()
        html.main_text(start * n + "text")
        return time.process_time() - began

    seconds(1000)
    assert seconds(40_000) < 30 * max(seconds(4_000), 0.02)


def test_pages_empty_and_with_further_columns(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (1, "u", "", "y"), (None, None, "<p>a</p>" * 20_000, "z")], "page_id long, url string, html string, text string")
    got = sorted(html.extract(pages).collect(), key=repr)
    assert [(r.page_id, len(r.text)) for r in got] == [(1, 0), (1, 0), (None, 39_999)]
    assert html.extract(pages.limit(0)).collect() == []


def test_broken_and_deep_pages():
    for page in ("<", "<p", "</p>", "<a href='x", "<!--", "<script>", "<div>" * 3000 + "x", "<b><p>" * 500 + "y", "<![CDATA[x]]>", "&#xZZ; &bogus;"):
        html.main_text(page)
    assert html.main_text("<div>" * 3000 + "deep") == "deep"


def test_pages_of_the_tables(spark):
    import html as entities

    rows = {r.page_id: r for r in html.op10_html_extraction(spark, FOLDER).collect()}
    for p in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        inside = re.search(r"<article>(.*)</article>", p.html, re.S)[1]
        parts = (re.sub(r"\s+", " ", entities.unescape(re.sub(r"<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)\b[^>]*>|<br>", inside))
        assert rows[p.page_id].text == "\n".join(x for x in parts if x) and rows[p.page_id].n_chars == len(rows[p.page_id].text)


# --- pipeline ---


def test_stages_keep_columns_and_filter(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), name)
        if name != "packing":
            assert docs.columns == columns
            sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 700
    assert docs.agg(F.count_distinct("doc_id")).first()[0] == sizes[-1]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_sql(spark, name):
    from oracle import assert_same

    assert_same(spark, "/root/testdata/sf0.001", queries.queries()[name], queries.oracle_sql()[name])


def test_queries_are_registered():
    assert {k.split("_")[0] for k in queries.queries()} == {f"op{k}" for k in range(1, 14)}
