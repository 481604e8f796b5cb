"""Collocations against a count of all phrases in Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from millrace.llm import collocations as c

SCHEMA = "text string, lang string, words string, n long, phrase string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least=10, top=2000):
    counts, totals = Counter(), Counter()
    for text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            lang = lang if lang is not None else "und"
            totals[lang] += len(words)
            for k in (1, 2, 3):
                for i in range(len(words) - k + 1):
                    counts[lang, tuple(words[i : i + k])] += 1
    longer = Counter()
    for (lang, p), a in counts.items():
        if len(p) == 3 and a >= least:
            for part in (p[:2], p[1:]):
                longer[lang, part] = max(longer[lang, part], a)
    found = {}
    for (lang, p), a in counts.items():
        if len(p) == 1 or a < least or 100 * longer[lang, p] >= 50 * a:
            continue
        cuts = [(counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p))]
        score, _, l, r = min((1_000_000 * a * a // (l * r), k, l, r) for k, (l, r) in enumerate(cuts))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted(
        (lang, rank, p.decode(), -a, l, r, totals[lang], -score)
        for lang, best in found.items() for rank, (score, a, p, l, r) in enumerate(sorted(best)[:top], 1))


def corpus():
    draw = random.Random(8)
    words = [w + x for w in ("On", "tÉ", "ab", "#", "z\x1c") for x in ("", "a", "bé", "C")]
    rows = [(None, "en"), ("", None), (" \t\n.", "en"), ("one two, three", "de"), ("x " * 5_000, "en")]
    for i in range(150):
        text = "".join(draw.choice(words[: draw.choice([3, 20])]) + draw.choice([" ", " ", "  ", "\t", ". ", "\n", " , "]) for _ in range(60))
        rows.append((text, draw.choice(["en", "en", "fr", None, "und"])))
    return [(*r, None, i, "x") for i, r in enumerate(rows + rows[5:9])]


@pytest.mark.parametrize("most", [c.MOST_ROWS, 25, 0])
def test_equal_plain_version(spark, monkeypatch, most):
    """With all numbers sent to the tasks, with those of words only, and with none: they are joined then."""
    rows = corpus()
    found = c.collocations(spark.createDataFrame(rows, SCHEMA), top=40, most_rows=most)
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, top=40)


def test_many_chunks(spark, monkeypatch):
    for name, value in (("CHUNK", 700), ("HELD", 900), ("GATHERED", 60)):
        monkeypatch.setattr(c, name, value)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    assert len(list(c.pieces(b"a b, c d. e" * 400))) > 5
    assert sorted(tuple(r) for r in c.collocations(docs).collect()) == plain(rows)


def test_nothing_to_find(spark):
    assert c.collocations(spark.createDataFrame([], SCHEMA)).count() == 0
    assert c.collocations(spark.createDataFrame([(None, None, None, 1, None), ("a b c", "en", None, 1, None)], SCHEMA)).count() == 0


def test_exact_beyond_64_bits(spark):
    a, l, r = 4_000_000_000_000, 5_000_000_000_000, 7_000_000_000_001
    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    assert df.select(c.ratio(df.a, df.l, df.r)).first()[0] == 1_000_000 * a * a // (l * r)


def test_pair_counts_of_tiles_and_lists():
    draw = np.random.default_rng(1)
    first, second = np.minimum(draw.geometric(0.05, (2, 20_000)), 90)
    counts = c.PairCounts(100, side=8, dense=200, tiles=3, listed=50)
    total = Counter()

    def drained():
        for cells, held in counts.drain():
            for cell, n in zip(cells.tolist(), held.tolist()):
                total[divmod(cell, 100)] += n

    for at in range(0, 20_000, 2_500):
        counts.add(first[at : at + 2_500], second[at : at + 2_500])
        assert counts.tiles and len(counts.cells)
        if counts.full:
            drained()
    drained()
    assert total == Counter(zip(first.tolist(), second.tolist())) and not counts.tiles
    with pytest.raises(ValueError, match="64-bit"):
        c.PairCounts(1 << 32)
