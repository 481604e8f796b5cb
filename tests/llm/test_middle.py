"""Fill-in-the-middle texts: exact cuts and round trips against a plain version."""

import hashlib
import random
import re

import numpy as np
import pytest

from millrace.llm.middle import ERROR, Format, RankIndex, boundaries, middle_filled, restored

TOKEN = re.compile("[A-Za-z]+|[^A-Za-z]")
SCHEMA = "doc_id long, text string, form string, output string, id string"


def plain(id, text):
    """(n, form, prefix_chars, middle_chars, output) by splitting the text into tokens."""
    text = text or ""
    units = TOKEN.findall(text)
    digest = hashlib.sha256(f"1:{'' if id is None else id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return len(units), form, len(p), len(m), out


def test_outputs_equal_plain_version(spark):
    draw = random.Random(3)
    texts = [None, "", "a", "<P>", "x <M> y", "é1\n", "😀 b😀", "a" * 70_000, "7" * 70_000, "ab c1 " * 30_000]
    texts += ["".join(draw.choice("abc dé\n1<P>S") for _ in range(draw.randint(0, 300))) for _ in range(200)]
    rows = [(i, t, "x", None, "y") for i, t in enumerate(texts)] + [(None, "no id here", None, "o", None), (10, "again", "x", "x", "x"), (10, "again", "x", "x", "x")]
    found = middle_filled(spark.createDataFrame(rows, SCHEMA)).withColumn("back", restored("output", "form")).collect()
    got = sorted(str((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output)) for r in found)
    assert got == sorted(str((i, *plain(i, t))) for i, t, *_ in rows)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert sorted((r.doc_id or -1, r.back) for r in found) == sorted((i or -1, t or "") for i, t, *_ in rows)


def test_empty_table(spark):
    assert middle_filled(spark.createDataFrame([], SCHEMA)).count() == 0


def test_index_is_exact_and_small():
    draw = np.random.default_rng(5)
    texts = ["", "x"]
    for n in (3, 500, 60_000):  # words of changing lengths, so that one line does not do
        texts.append(" ".join("w" * k for k in np.repeat(draw.integers(1, 60, n // 100 + 1), 100)[:n]))
    offsets, firsts, starts = boundaries(texts)
    index = RankIndex(offsets, firsts)
    assert (index.offsets(np.arange(len(offsets))) == offsets).all()
    assert np.abs(index.predicted(np.arange(len(offsets))) - offsets).max() <= ERROR
    assert len(index.starts) < len(offsets) / 50
    for text, first, last, start in zip(texts, firsts, [*firsts[1:], len(offsets)], starts):
        places = np.cumsum([0, *map(len, TOKEN.findall(text))])
        assert (offsets[first:last] - start == places).all()


def test_other_markers(spark):
    marks = Format(prefix="[pre]", suffix="[suf]", middle="[mid]", plain_percent=0, spm_percent=50)
    texts = ["[p[suf one two", "<P> three four five"] + [f"a{i} b c [" for i in range(40)]
    found = middle_filled(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), format=marks)
    rows = found.withColumn("back", restored("output", "form", marks)).collect()
    assert {r.form for r in rows} == {"psm", "spm"} and all(r.back == texts[r.doc_id] for r in rows)
    for bad in (("<P>", "<P>x", "<M>"), ("", "<S>", "<M>"), ("<P", "<<", "<M>")):
        with pytest.raises(ValueError, match="markers"):
            Format(*bad)
