"""SetSketch near duplicates against all pairs of full sets."""

import random
import re

import numpy as np
import pytest

from millrace.llm import near_dedup
from millrace.llm.near_dedup import first_of_groups, near_duplicates
from millrace.llm.setsketch import banding, bands, merged, registers, similarity
from millrace.llm.stars import components
from millrace.llm.tables import Scratch
from millrace.llm.words import Hasher

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, component_id string, kept string"


def brute(rows, words, percent):
    """doc_id -> (shingles, component) by comparing all pairs."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    sets = {}
    for i, text in rows:
        found = WORD.findall((text or "").translate(str.maketrans(upper, upper.lower())))
        n = min(words, len(found))
        sets[i] = {tuple(found[k : k + n]) for k in range(len(found) - n + 1)} if n else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed, groups=12, size=30):
    """Texts in groups of copies with more and more edits, whose links form chains and stars."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randint(2, 6)))
    rows = []
    for _ in range(groups):
        base = [word() for _ in range(draw.choice([4, 40, 120, 300]))]
        for _ in range(draw.randint(1, size)):
            text = list(base)
            for _ in range(draw.randint(0, max(1, len(base) // 25))):
                text[draw.randrange(len(text))] = word()
            if draw.random() < 0.2:
                base = text  # the next copies are copies of this one
            rows.append((len(rows), draw.choice([" ", "\n", "  "]).join(text)))
    return rows


@pytest.mark.parametrize(("words", "threshold"), [(3, 0.85), (5, 0.8)])
def test_components_equal_brute_force(spark, words, threshold):
    rows = corpus(words)
    found = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=words, threshold=threshold)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()}
    assert got == brute(rows, words, round(100 * threshold))
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())


def test_one_group_of_copies_beside_others(spark):
    """A third of all rows are near copies of one text, some of them too far to be linked with any."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(140)]
    rows = []
    for i in range(300):
        text = list(base) if i % 3 == 0 else [word() for _ in range(60)]
        for _ in range(draw.randint(0, 12) if i % 3 == 0 else 0):
            text[draw.randrange(len(text))] = word()
        rows.append((i, " ".join(text)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), words=3, threshold=0.85).collect()}
    assert got == brute(rows, 3, 85)


def test_blocks_count_and_span(monkeypatch):
    draw = np.random.default_rng(8)
    sets = [np.unique(draw.integers(0, 300, draw.integers(0, 90))) for _ in range(40)]
    monkeypatch.setattr(near_dedup, "COLUMNS", 64)
    want = [[len(np.intersect1d(x, y)) for y in sets[15:]] for x in sets[:15]]
    assert near_dedup.shared_counts(sets[:15], sets[15:]).tolist() == want
    assert near_dedup.shared_counts([], sets).shape == (0, 40)
    links = near_dedup.spanning([1, 2, 3, 1, 5], [2, 3, 1, 3, 6])
    assert links == [(1, 2), (2, 3), (5, 6)]


def test_many_blocks(spark, monkeypatch):
    """Copies that edits have moved apart from each other, in buckets of several blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    draw = random.Random(15)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(150)]
    rows = []
    for i in range(250):
        text = list(base)
        for _ in range(draw.choice([2, 3, 3, 4, 5])):
            text[draw.randrange(len(text))] = word()
        rows.append((i, " ".join(text)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string"), words=3, threshold=0.85).collect()}
    want = brute(rows, 3, 85)
    assert got == want and len({c for _, c in want.values()}) > 20


def test_odd_rows(spark):
    rows = [
        (1, None, None, "x", None), (2, "", "de", None, "y"), (3, " \t\n", "de", None, "y"), (4, "one", None, None, None),
        (5, "ONE", None, None, None), (6, "one two three", None, None, None), (6, "one two three", None, None, None),
        (None, "one two three", None, None, None), (7, "One  two\tthree", None, None, None), (8, "a " * 20_000, None, None, None),
    ]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect())
    assert got == [
        (0, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False),
        (6, 1, 6, True), (6, 1, 6, True), (7, 1, 6, False), (8, 1, 8, True),
    ]
    left = first_of_groups(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in left.collect()) == [0, 1, 2, 3, 4, 6, 8]


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(docs).count() == 0 and first_of_groups(docs).columns == docs.columns


def test_registers_merge_and_estimate():
    draw = np.random.default_rng(3)
    x = draw.integers(0, 2**63, 4000, dtype=np.uint64)
    a, b = registers(x[:2500], 180), registers(x[1500:], 180)
    assert (merged(a, b) == registers(x, 180)).all()
    assert (registers(x[::-1].copy(), 180) == registers(x, 180)).all()
    assert not registers(x[:0], 180).any()
    for n, shared in ((400, 380), (300, 150), (20, 18)):
        errors = []
        for _ in range(40):
            y = draw.integers(0, 2**63, 2 * n - shared, dtype=np.uint64)
            sizes = np.array([float(n)])
            estimate = similarity(registers(y[:n], 252)[None], registers(y[n - shared :], 252)[None], sizes, sizes)[0]
            errors.append(estimate - shared / (2 * n - shared))
        assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05


def test_banding_reaches_its_recall():
    for threshold in (0.8, 0.85, 0.95):
        rows, count = banding(threshold)
        assert (1 - threshold**rows) ** count <= 1e-6 and count <= 40
    keys = bands(np.arange(24, dtype=np.uint16), 6)
    assert len(set(keys.tolist())) == 4


def test_components_of_chains_and_stars(spark):
    draw = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, i) for i in range(200, 260)] + [(260, 300), (259, 260)]
    edges += [(b, a) for a, b in edges[::7]] + [(5, 5)]
    draw.shuffle(edges)
    with Scratch(spark) as scratch:
        got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {**{i: 100 for i in range(101, 141)}, **{i: 7 for i in [*range(200, 261), 300]}}


def test_hashes_do_not_depend_on_pieces():
    text = ("Aé bc  d" * 50 + " " + "x" * 300).encode() * 3
    small, large = Hasher(64), Hasher()
    assert (small.shingles(text[:500], 3) == large.shingles(text[:500], 3)).all()
    assert len(small.shingles(text, 3)) == len(large.shingles(text, 3))
