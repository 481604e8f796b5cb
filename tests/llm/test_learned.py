"""Decontamination, page text and the learned scores."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import classifier, leaks, pages, toxicity
from millrace.llm.additive import fit
from millrace.llm.trees import fit_tree, predict
from millrace.llm.words import Hasher

DOCS = "doc_id long, text string, lang string, id string, score string"


# --- decontamination --------------------------------------------------------------------------------------

def words_of(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def plain_edits(item, doc):
    """Fewest word edits between the item and any part of the document."""
    row = [0] * (len(doc) + 1)
    for i, x in enumerate(item, 1):
        new = [i]
        for j, y in enumerate(doc, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def edited(draw, words, count):
    words = list(words)
    for _ in range(count):
        at = draw.randrange(len(words))
        words[at : at + 1] = draw.choice([[], ["qq"], [words[at], "zz"]])
    return words


def leak_tables(seed, share):
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 6))) for _ in range(400)] + ["the", "of"] * 40
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.randint(12, 60)))) for i in range(40)]
    docs = []
    for i in range(160):
        text = [draw.choice(vocabulary) for _ in range(draw.randint(0, 120))]
        if i % 2:
            item = words_of(items[i % 40][1])
            at = draw.randint(0, len(text))
            text[at:at] = edited(draw, item, int(share * len(item)))
        docs.append((i, draw.choice([" ", "\n", ", "]).join(text)))
    return docs, items


@pytest.mark.parametrize("share", [0.0, 0.1, 0.2])
def test_leaks_equal_brute_force(spark, share):
    docs, items = leak_tables(3, share)
    found = leaks.leaked_passages(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r for r in found.collect()}
    want = {}
    for d, text in docs:
        doc = words_of(text)
        for i, item in items:
            edits = plain_edits(words_of(item), doc)
            if edits <= 0.2 * len(words_of(item)):
                want[d, i] = edits
    assert set(got) <= set(want)  # what is reported is exact
    assert len(set(want) - set(got)) <= 0.02 * len(want)
    texts = dict(docs)
    for key in got:
        r = got[key]
        part = words_of(texts[r.doc_id])[r.first_word : r.first_word + r.n_words]
        assert r.edits == want[key] and plain_edits(words_of(dict(items)[r.item_id]), part) == r.edits


def test_leak_recall():
    """Passages with a fifth of their words edited, in many random texts."""
    draw = random.Random(9)
    _, items = leak_tables(11, 0)
    table = leaks.Items([t for _, t in items])
    hasher, docs, want = Hasher(), [], []
    for k in range(600):
        item = words_of(items[k % 40][1])
        text = [f"w{draw.randrange(500)}" for _ in range(60)]
        text[20:20] = edited(draw, item, int(0.2 * len(item)))
        docs.append(leaks.tokens(" ".join(text).encode(), hasher))
        want.append(k % 40)
    found = table.find(docs)
    assert np.mean([any(x[0] == i for x in f) for f, i in zip(found, want)]) >= 0.98


@pytest.mark.parametrize("size", [60, 100, 300, 1000])
def test_leak_recall_of_long_items(size):
    """A fifth of the words edited at random or cut from either end, far past the first words of the item."""
    draw, hasher, most = random.Random(size), Hasher(), size // 5
    items = [[f"w{draw.randrange(3000)}" for _ in range(size)] for _ in range(8)]
    table = leaks.Items([" ".join(i) for i in items])
    for change in (lambda x: x, lambda x: edited(draw, x, most), lambda x: x[most:], lambda x: x[:-most]):
        docs = []
        for k in range(24):
            around = [f"x{draw.randrange(500)}" for _ in range(draw.randrange(40, 80))]
            docs.append(leaks.tokens(" ".join([*around[:30], *change(items[k % 8]), *around[30:]]).encode(), hasher))
        found = table.find(docs)
        assert np.mean([any(x[0] == k % 8 for x in f) for k, f in enumerate(found)]) >= 0.95


def test_leaks_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    docs = spark.createDataFrame(
        [(1, None, "x", "a", "b"), (2, "", "x", "a", "b"), (None, "A b, c", "x", "a", "b"), (4, "a B c", "x", "a", "b"),
         (4, "a B c", "x", "a", "b"), (5, long, "x", "a", "b"), (6, "c b a", None, None, None)], DOCS)
    items = spark.createDataFrame(
        [(1, "a b c"), (None, "a b c"), (2, None), (3, ""), (4, "w29990 w29991 x w29992 w29993 w29994 w29995"), (4, "a b c")],
        "item_id long, text string")
    got = sorted(((r.doc_id or 0, r.item_id or 0, r.edits) for r in leaks.leaked_passages(docs, items, block=2).collect()))
    assert got == sorted([(d, i, 0) for d in (0, 4, 4) for i in (0, 1, 4)] + [(5, 4, 1)])
    left = leaks.without_leaks(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 6]
    assert leaks.leaked_passages(docs, items.limit(0)).count() == 0 == leaks.leaked_passages(docs.limit(0), items).count()
    assert leaks.without_leaks(docs, items.limit(0)).count() == docs.count()


# --- pages ------------------------------------------------------------------------------------------------

def extracted(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "page_id long, html string").withColumn("url", F.lit("u")).withColumn("text", F.lit("x"))
    rows = {r.page_id: r.text for r in pages.extract_pages(table).collect()}
    return [rows[i] for i in range(len(texts))]


def test_page_text(spark):
    p = "<p>" + "word " * 30
    got = extracted(spark, [
        None, "", "<p>", "plain",
        "<article><h1>A &amp; B</h1><p>x&nbsp;y<br>z &#8364;<p>" + "<b>q</b> <a href='a>b'>link</a></article><footer>f</footer>",
        f"<html><body class=has-sidebar><nav><a>m</a></nav><div id=main><h2>Head</h2>{p}</p><p>short</p>{p}</div>"
        "<div class='cookie-notice'>" + "we use " * 40 + "</div><aside>" + p + "</aside></body>",
        "<article><p>a<script>var x='</p>b';</script><style>p{}</style><!-- <p>c</p> --></p><form><p>d</p></form>"
        "<section class=comments><article class=comment><p>" + "e " * 50 + "</article></section><p>f</article>",
        "<nav><a>open menu<article><p>text</p></article>", "<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000,
        "<article><ul><li>one<li>two</ul><table><tr><td>3<td>4</table><div hidden>no</div><p>a<br><br>b</article>",
        "<article>a < b <i>c</i>d &lt;p&gt; &unknown; &copy</article>",
    ])
    w = "word " * 29 + "word"
    assert got == [
        "", "", "", "plain", "A & B\nx y z €\nq link", f"Head\n{w}\nshort\n{w}", "a\nf", "text", "deep", "one\ntwo\n3\n4\na\nb",
        "a < b cd <p> &unknown; ©",
    ]


def test_test_pages_give_exactly_their_articles(spark):
    import html

    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r.page_id: r.html for r in table.collect()}
    for r in pages.extract_pages(table).collect():
        article = re.search(r"<article>(.*?)(?:</article>|<footer>)", source[r.page_id], re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article).replace("<br>", " "))
        assert r.text == "\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_tree_learns_its_table():
    table = pages.labelled_table()
    tree = pages.learned_tree()
    assert all((predict(tree, tuple(row[:-1])) > 0.5) == bool(row[-1]) for row in table)
    assert fit_tree(np.zeros((4, 2)), np.array([0.0, 1, 1, 1]), 3) == (0.75,)


def test_held_out_blocks(monkeypatch):
    """Each labelled page by a tree that has learned from the others."""
    every, hits, total = pages.LABELLED, 0, 0
    for i, page in enumerate(every):
        monkeypatch.setattr(pages, "LABELLED", every[:i] + every[i + 1 :])
        tree = pages.learned_tree()
        monkeypatch.setattr(pages, "LABELLED", [page])
        for row in pages.labelled_table():
            hits += (predict(tree, tuple(row[:-1])) > 0.5) == bool(row[-1])
            total += 1
    assert hits / total > 0.9


def test_density_and_names_decide():
    tree = pages.learned_tree()
    w = " ".join(["word"] * 30)
    links = "".join(f"<li><a>link {i}</a></li>" for i in range(5))
    for page, want in (
        (f"<main><ul>{links}</ul><p>Some text is said here.</p></main>", "Some text is said here."),
        ("<article><p>Text of it.</p><p><a>Buy now cheap shoes</a></p><p>More.</p></article>", "Text of it.\nMore."),
        (f"<h1>T</h1><p>{w}</p><p>He left.</p>", f"T\n{w}\nHe left."),
        ("<h1>At dawn</h1><p>Hello.</p><p>Who?</p><p>Me.</p>", "At dawn\nHello.\nWho?\nMe."),
        ('<article><section id="social-history"><p>a b</p></section><div class="notice-of-change">c</div>'
         '<div class="product-comment-free">d</div><div class="x ad-slot">e</div></article>', "a b\nc\nd"),
        ("<p>a</p><!-- open <p>b</p>", "a"), ("a <b", "a <b"), ("a <!-- b", "a"),
    ):
        assert pages.main_text(page, tree) == want


def test_long_pages_take_linear_time():
    tree = pages.learned_tree()
    for part, count in (("<div>", 60_000), ("</span2>", 60_000), ('<a "', 100_000), ("<li><x>", 40_000), ("<main>", 60_000),
                        ("<!--", 100_000), ("<script ", 60_000), ("<p a='", 60_000)):
        start = time.perf_counter()
        pages.main_text("<div>" * 20_000 + part * count, tree)
        assert time.perf_counter() - start < 15, part


def test_empty_table_of_pages(spark):
    assert pages.extract_pages(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


# --- learned scores ---------------------------------------------------------------------------------------

def ranked(rows, label):
    """Area under the curve of scored rows."""
    pos = [r.score for r in rows if label[r.doc_id]]
    neg = [r.score for r in rows if not label[r.doc_id]]
    return np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])


def labelled_texts(kind, count=400):
    draw = random.Random(6)
    plain = ["the", "house", "grün", "walks", "over", "there", "maybe", "tomorrow"]
    rows, label = [], {}
    for i in range(count):
        words = [draw.choice(plain) + draw.choice(["", "s", "en", "ly"]) for _ in range(draw.randint(5, 80))]
        label[i] = int(draw.random() < 0.3)
        if label[i]:
            for _ in range(draw.randint(1, 4)):
                at = draw.randrange(len(words))
                words[at] = "zorgu" + draw.choice(["at", "en", "is", "x"]) if kind == "toxic" else words[at].upper() + "!!"
            words = words if kind == "toxic" else words[:3] * 12 + words
        rows.append((i, " ".join(words)))
    return rows, label


def test_toxicity_on_held_out_rows(spark):
    rows, label = labelled_texts("toxic")
    rows += [(1000, None), (1001, ""), (None, "zorguat"), (1002, "you 1d10t " * 20_000)]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)
    labels = spark.createDataFrame([(i, v) for i, v in label.items() if i % 3] + [(None, 1), (5, None)], "id long, label int")
    found = toxicity.toxicity_scores(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.doc_id is not None and r.doc_id < 1000 and r.doc_id % 3 == 0]
    assert ranked(held, label) > 0.97
    again = {r.doc_id: r.score for r in toxicity.toxicity_scores(docs.repartition(5), labels).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in found)


def test_toxicity_features():
    found = dict(zip(toxicity.FEATURES, toxicity.features("You 1d1ot! st*pid SO baaad zorguat", {"zorgu": 3.0})))
    assert found["insults"] == pytest.approx(1 / 6) and found["learned"] == pytest.approx(1 / 6) and found["top_weight"] == 3.0
    assert found["disguised"] > 0 and found["stretched"] > 0 and found["near_person"] > 0 and found["capital_words"] > 0
    assert toxicity.features("", {})[0] == 0.0


def test_quality_on_held_out_rows(spark):
    rows, label = labelled_texts("quality")
    rows += [(1000, None), (1001, " \n"), (None, "a b"), (1002, "word " * 50_000)]
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)
    labels = spark.createDataFrame([(i, v) for i, v in label.items() if i % 3] + [(None, 1)], "id long, label int")
    found = classifier.quality_scores(docs, labels).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    held = [r for r in found if r.doc_id is not None and r.doc_id < 1000 and r.doc_id % 3 == 0]
    assert ranked(held, label) > 0.97
    empty = {r.doc_id: r.score for r in found}
    assert empty[1000] == empty[1001]


@pytest.mark.parametrize("score", [toxicity.toxicity_scores, classifier.quality_scores])
def test_scores_without_labels(spark, score):
    docs = spark.createDataFrame([(1, "a", "x", "y", "z"), (2, None, "x", "y", "z")], DOCS)
    none = spark.createDataFrame([], "id long, label int")
    assert len({r.score for r in score(docs, none).collect()}) == 1
    one = spark.createDataFrame([(1, 1)], "id long, label int")
    assert score(docs, one).count() == 2 and score(docs.limit(0), one).count() == 0


def test_additive_model_learns_an_interaction():
    draw = np.random.default_rng(1)
    x = draw.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = fit(x, y)
    assert model.pairs[0] == (0, 1)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95
    assert ((fit(x, y, n_pairs=0).score(x) > 0.5) == y).mean() < 0.7
    constant = fit(np.zeros((10, 3)), np.ones(10))
    assert (constant.score(np.zeros((2, 3))) > 0.9).all()
