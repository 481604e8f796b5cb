"""Personal data: base patterns against plain regular expressions, and the field on held-out examples."""

import itertools
import random
import re
import time

import numpy as np
import pytest

from millrace.llm import private, queries
from millrace.llm.skipchain import ALIKE, CHAIN, SAME, Graph, SkipChain

SCHEMA = "doc_id long, text string, spans string, id string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
            fits = {
                "email": True, "ip": all(int(p) <= 255 for p in m[0].split(".") if kind == "ip"),
                "card": 16 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in doubled) % 10 == 0,
                "phone": 8 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def odd_texts():
    draw = random.Random(4)
    texts = [None, "", " ", "é@x.de", "a@b@c.de", "a@b.c.d-e@f.g", "x@.de", "@a.b", "1.2.3.4.5.6.7.8.9", "300.1.1.1 1.1.1.1", "0.00.000.0001",
             "4111 1111-1111 1111", "4111111111111111" * 2, "+1 (771) 555-1655+49 30 1234567.", "+12", "é+1 23456789 é 9870157079875996"]
    for _ in range(300):
        texts.append("".join(draw.choice(["a", "é", "@", ".", "1", "25", "4111", " ", "-", "+", "(", ")", "\n", "x.y"]) for _ in range(draw.randint(1, 60))))
    return texts


def test_base_spans_equal_plain_patterns(spark):
    texts = odd_texts()
    rows = [(i, t, None, "x") for i, t in enumerate(texts)] + [(None, "x@y.de", "a", None), (3, "é@x.de", None, None)]
    base = set(PATTERNS)
    for r in private.private_spans(spark.createDataFrame(rows, SCHEMA)).collect():
        text = "x@y.de" if r.doc_id is None else texts[r.doc_id]
        assert [s for s in r.spans if s.split(":")[0] in base] == plain(text), text
        later = [s.split(":") for s in r.spans if s.split(":")[0] not in base]
        assert later == sorted(later, key=lambda s: (private.KINDS.index(s[0]), int(s[1])))
        taken = {i for s in plain(text) for i in range(*map(int, s.split(":")[1:]))}
        assert not any(i in taken for _, a, b in later for i in range(int(a), int(b)))


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert private.private_spans(docs).count() == 0 and private.mask_private(docs).columns == docs.columns


@pytest.fixture(scope="module")
def finder():
    return private.Finder(*private.learned())


def found(finder, text, skips=True):
    data = text.encode()
    return {(private.KINDS[k], data[a:b].decode()) for k, a, b in finder.spans([data], skips)[0]}


def counts(finder, texts, **options):
    hits = wrong = missed = 0
    for text, marks in texts:
        data = text.encode()
        got = {(k - 3, len(data[:a].decode()), len(data[:b].decode())) for k, a, b in finder.spans([data], **options)[0] if k > 3}
        hits, wrong, missed = hits + len(got & set(marks)), wrong + len(got - set(marks)), missed + len(set(marks) - got)
    return hits / (hits + wrong), hits / (hits + missed)


def test_held_out_examples_and_what_skips_add(finder):
    draw = random.Random(99)
    texts = [private.example(draw) for _ in range(300)]
    precision, recall = counts(finder, texts)
    assert precision > 0.93 and recall > 0.78
    assert counts(finder, texts, skips=False)[1] < recall - 0.15


def test_repeated_tokens_take_the_label(finder):
    text = "Yesterday Dr. Anna Zorbel called. " + "the weather was fine and nothing happened at all. " * 20 + "Then old Zorbel went home."
    data = text.encode()
    names = [(a, b) for k, a, b in finder.spans([data])[0] if k == 4]
    assert [data[a:b] for a, b in names] == [b"Anna Zorbel", b"Zorbel"] and names[1][0] > 900
    assert len(finder.spans([data], skips=False)[0]) == 1
    assert ("number", "771 555 1655") in found(finder, "Call +1 (771) 555-1655 or 771 555 1655 now.")


def test_ordinary_texts_have_none(finder):
    for text in ("The street was long. In 1999 there were 40000 people. Order 12345678 shipped. The President spoke. The President left.",
                 "SOME WORDS!! IN!! CAPITALS!! 55.148.143.52!! AND!! MORE!!", "The name of the rose. The house of cards."):
        assert {k for k, _ in found(finder, text)} <= {"ip"}


def test_masking(spark, finder):
    docs = spark.createDataFrame([(1, "Dear Mr. Klimt, mail a.b@mail.example.com or call +1 (771) 555-1655.", None, "x"), (2, None, None, None)], SCHEMA)
    got = {r.doc_id: r.text for r in private.mask_private(docs).collect()}
    assert got == {1: "Dear Mr. [NAME], mail [EMAIL] or call [PHONE].", 2: None}


def test_long_texts_take_linear_time(finder):
    texts = ["a" * 400_000 + " x@y.de", "1" * 400_000, "1." * 200_000, "+1 " * 130_000, "@a" * 200_000, "a@" * 200_000,
             "Dr. Zorbel " * 30_000, "Mr. Klimt 12345 Ave\n" * 10_000, "-" * 400_000]
    for text in texts:
        start = time.perf_counter()
        finder.spans([text.encode()])
        assert time.perf_counter() - start < 20, text[:20]


def test_messages_are_exact_on_a_tree():
    draw = np.random.default_rng(2)
    field = SkipChain(3, 4)
    field.single, field.pair = draw.normal(size=(4, 3)), draw.normal(size=(4, 3, 3))
    a, b, kind = np.array([0, 1, 1, 3]), np.array([1, 2, 3, 4]), np.array([CHAIN, CHAIN, SAME, ALIKE])
    g = Graph(np.array([-1, -1, -1, -1, 2]), np.arange(5), np.array([0, 1, 2, 3, 0]), a, b, kind)
    nodes, edges = field.marginals(g, rounds=60)
    want = np.zeros((5, 3))
    pairs = np.zeros((4, 3, 3))
    for y in itertools.product(range(3), repeat=5):
        if y[4] != 2:
            continue
        weight = np.exp(sum(field.single[g.feature[i], y[i]] for i in range(4)) + sum(field.pair[k, y[i], y[j]] for i, j, k in zip(a, b, kind)))
        for i in range(5):
            want[i, y[i]] += weight
        for e in range(4):
            pairs[e, y[a[e]], y[b[e]]] += weight
    assert np.allclose(nodes, want / want.sum(1, keepdims=True), atol=2e-3)
    assert np.allclose(edges, pairs / pairs.sum((1, 2), keepdims=True), atol=2e-3)


def test_query_counts_base_spans(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op11_personal_data(spark, sf).collect():
        want = plain(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(f"{k}:") for s in want) for k in PATTERNS]
        assert r.spans.split(",")[: len(want)] == (want or [""])[: len(want)]
