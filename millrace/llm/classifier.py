"""Quality classifier: a generalised additive model over dense features of a text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.additive import Additive, fit
from millrace.llm.quality import LEADS, SYMBOLS, covered, repeats
from millrace.llm.tables import Scratch, labelled_sample, parts, text_bytes
from millrace.llm.words import Hasher, byte_table, spans

FEATURES = (
    "log_words", "mean_word", "log_longest_word", "symbols", "bars", "capitals", "digits", "sentence_marks", "exclamations", "commas",
    "other_marks", "log_lines", "words_a_line", "distinct_words", "twins", "repeated_pairs", "repeated_fives", "repeated_lines",
    "top_word", "beyond_ascii",
)
SAMPLE = 12_000
LINE_BYTES = byte_table(b"\n", inverted=True)


class Measure:
    """The features of one text; holds the tables of the hashes."""

    def __init__(self):
        self.hasher = Hasher()

    def __call__(self, text: bytes) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        data = np.frombuffer(text, np.uint8)
        starts, ends = spans(data)
        n = len(starts)
        if not n:
            return out
        counts = np.bincount(data, minlength=256)
        chars = max(1, int(counts @ LEADS))

        def share(members: bytes, of: int) -> float:
            return float(counts[list(members)].sum()) / of

        sizes = ends - starts
        words = self.hasher.words(data, starts, ends)
        counts_of = np.unique(words, return_counts=True)[1]
        line_starts, line_ends = spans(data, LINE_BYTES)
        lines = self.hasher.words(data, line_starts, line_ends)
        later = repeats(lines)[1]
        out[:] = (
            np.log1p(n), sizes.mean(), np.log(sizes.max()), share(SYMBOLS, n), share(b"|", n),
            share(bytes(range(65, 91)), chars), share(bytes(range(48, 58)), chars), share(b".?", n), share(b"!", n), share(b",;:", n),
            share(b"()[]{}\"'/\\_~^+=", n), np.log1p(len(lines)), n / max(1, len(lines)), len(counts_of) / n,
            float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0,
            float(covered(repeats(self.hasher.grams(words, 2))[1], 2, n).mean()),
            float(covered(repeats(self.hasher.grams(words, 5))[1], 5, n).mean()),
            float((line_ends - line_starts)[later].sum()) / len(data), counts_of.max() / n, share(bytes(range(128, 256)), len(data)),
        )
        return out


def measured(texts: DataFrame) -> DataFrame:
    """(id, label, x) of a table (id, text as bytes, label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure()
        for batch in parts(batches):
            x = pa.array([measure(t) for t in batch.column(1).to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), x], names=["id", "label", "x"])

    return texts.select("id", "text", "label").mapInArrow(run, "id long, label int, x array<double>")


def learn(texts: DataFrame, labels: DataFrame, bound: int) -> Additive:
    """The model from at most ``bound`` labelled rows (see ``labelled_sample``); the driver gets their features, ``bound`` rows
    of 20 numbers."""
    with Scratch(texts.sparkSession) as scratch:
        chosen = labels.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label"))
        rows = measured(scratch.save(labelled_sample(texts, scratch.save(chosen), bound))).select("id", "label", "x").collect()
    rows.sort(key=lambda r: (r.id, list(r.x)))
    x = np.array([r.x for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r.label for r in rows], float))


def quality_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE
) -> DataFrame:
    """One row for each document row: doc_id, score (probability of label 1).

    ``labels`` has (id, label 0 or 1). Texts that are null or without words have all features 0 and are scored, too; null
    ids are scored but never learned from. Without labelled rows every score is 0.5, with one label only near that label.
    """
    texts = text_bytes(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    model = learn(texts, labels, bound)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure()
        for batch in parts(batches):
            x = np.array([measure(t) for t in batch.column(1).to_pylist()]).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return texts.mapInArrow(run, "doc_id long, score double")
