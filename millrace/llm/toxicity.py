"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import Scratch, labelled_sample, map_rows, text_bytes
from millrace.session import write_and_read

# Common insults, and words that address a person, in the languages of the corpus.
INSULTS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown imbecile fool dumbass "
    "jerk filthy bastard arschloch dumm dummkopf trottel depp abschaum vollidiot schwachkopf versager connard imbécile "
    "salaud crétin débile abruti ordure idiota estúpido estúpida imbécil tonto basura escoria inútil cabrón".split()
)
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes "
    "vosotros".split()
)
DISGUISES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
WORD = re.compile(r"[^\x20\x09-\x0D]+")
EDGES = "\"'.,;:!?()[]{}<>«»„“”‘’¿¡*_~-"
INSIDE = re.compile(r"[*._\-~]")
LONG_RUN = re.compile(r"(.)\1\1")
STEMS = (4, 5, 6)
NEAR = 5  # words between an insult and the person it addresses
FEATURES = (
    "log_words", "insults", "learned", "log_learned", "weight", "top_weight", "second_person", "near_person", "capitals",
    "capital_words", "exclamations", "questions", "punctuation", "disguised", "stretched",
)
LEXICON = 150
SAMPLE = 12_000


def tokens(text: str) -> Iterator[tuple[str, str, str]]:
    """(word, plain form, form without disguise) of every word."""
    for word in WORD.findall(text):
        plain = word.strip(EDGES).lower()
        yield word, plain, INSIDE.sub("", plain.translate(DISGUISES)) if not plain.isalpha() else plain


def stems(word: str) -> set[str]:
    """The word, and its beginnings, which stand for all its endings."""
    return {f"={word}", *(word[:n] for n in STEMS if len(word) >= n)}


def features(text: str, lexicon: Mapping[str, float]) -> list[float]:
    total = insults = learned = disguised = stretched = capital_words = near = person = 0
    weight = top = 0.0
    last_person = last_hit = -NEAR - 1
    known: dict[str, float] = {}
    for at, (word, plain, form) in enumerate(tokens(text)):
        total += 1
        if form not in known:
            known[form] = max((lexicon.get(s, 0.0) for s in stems(form)), default=0.0)
        score = known[form]
        hit = form in INSULTS
        insults += hit
        if score > 0:
            learned += 1
            weight += score
            top = max(top, score)
        if hit or score > 0:
            disguised += form != plain
            near += at - last_person <= NEAR
            last_hit = at
        if form in SECOND_PERSON:
            person += 1
            near += at - last_hit <= NEAR
            last_person = at
        capital_words += len(plain) > 1 and word.isupper()
        stretched += LONG_RUN.search(plain) is not None
    n, chars = max(1, total), max(1, len(text))
    marks = sum(map(text.count, ".,;:'\"()-"))
    return [
        math.log1p(total), insults / n, learned / n, math.log1p(learned), weight / n, top, person / n, near / n,
        sum(map(str.isupper, text)) / chars, capital_words / n, text.count("!") / n, text.count("?") / n, marks / chars,
        disguised / n, stretched / n,
    ]


def learned_lexicon(texts: DataFrame, size: int) -> dict[str, float]:
    """Words and beginnings of words that tell toxic from other texts: log odds of the ``size`` with the largest
    likelihood ratio. Tasks count documents first; the driver gets ``size`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                forms = {form for *_, form in tokens(text.decode()) if form}
                counts[label].update(set().union(*map(stems, forms)) if forms else ())
        stems_seen = list(counts[0] | counts[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(stems_seen, pa.string()), *(pa.array([c[s] for s in stems_seen], pa.int64()) for c in counts)],
            names=["stem", "other", "toxic"],
        )

    n_toxic, n_all = texts.agg(F.coalesce(F.sum("label"), F.lit(0)), F.count("*")).first()
    n_other = n_all - n_toxic
    if not n_toxic or not n_other:
        return {}
    found = texts.select("text", F.col("label").cast("int")).mapInArrow(run, "stem string, other long, toxic long")
    found = found.groupBy("stem").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).where("toxic >= 3")

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    seen = F.col("toxic") + F.col("other")
    ratio = part(F.col("toxic"), seen * n_toxic / n_all) + part(F.col("other"), seen * n_other / n_all)
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("other") + 0.5) / (n_other + 1))
    best = found.withColumn("odds", odds).where("odds > 2").orderBy(ratio.desc(), "stem").limit(size)
    return {r.stem: r.odds for r in best.select("stem", "odds").collect()}


def scored(docs: DataFrame, lexicon: Mapping[str, float], keep: tuple[str, ...] = ()) -> DataFrame:
    """id, features and the columns to keep of a table (id, text as bytes)."""
    kept = dict(docs.dtypes)

    def make() -> Callable:
        return lambda id, text, *rest: (id, features(text.decode(), lexicon), *rest)

    schema = ", ".join(["id long", "x array<double>", *(f"{c} {kept[c].replace('bigint', 'long')}" for c in keep)])
    return map_rows(docs.select("id", "text", *keep), make, schema)


def bounded_sample(texts: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """(id, text, label, part) of at most ``bound`` labelled rows (see ``labelled_sample``); part is a hash below 100 that says
    what a row is used for."""
    part = F.pmod(F.xxhash64("id", F.lit("part")), F.lit(100)).cast("int")
    return labelled_sample(texts, labels, bound).withColumn("part", part)


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", bound: int = SAMPLE,
    lexicon_size: int = LEXICON, rounds: int = 20, depth: int = 3,
) -> DataFrame:
    """One row for each document row: doc_id, score from 0 to 1, and features (in the order of FEATURES).

    ``labels`` has (id, label 0 or 1). The model learns from at most ``bound`` labelled rows: a lexicon of telling words
    and beginnings of words from 40 of 100 of them, the boosted trees from another 40, the isotonic calibration from the
    rest. Features are lexicon densities, nearness to a second person, capitals, punctuation and disguised words; ids and
    other columns are never among them. A null text is an empty one and is scored, too; without labelled rows, or with
    only one label among those a step learns from, every score is the share of label 1 (0 without any row).
    """
    texts = text_bytes(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    with Scratch(docs.sparkSession) as scratch:
        chosen = scratch.save(labels.select(F.col("id").cast("long").alias("id"), F.col("label").cast("int").alias("label")))
        sample = scratch.save(bounded_sample(texts.where("id is not null"), chosen, bound))
        lexicon = learned_lexicon(sample.where("part < 40"), lexicon_size)
        fitted = scratch.save(scored(sample.where("part >= 40"), lexicon, ("label", "part")).select(
            array_to_vector("x").alias("features"), F.col("label").cast("double").alias("label"), "part"))
        classes = fitted.groupBy("label").agg(
            F.count_if(F.col("part") < 80).alias("fit"), F.count_if(F.col("part") >= 80).alias("calibrate")).collect()
        all_scored = scored(texts, lexicon)
        if len(classes) < 2 or not all(r.fit for r in classes):
            share = sample.agg(F.coalesce(F.avg("label"), F.lit(0.0))).first()[0]
            return write_and_read(all_scored.select(F.col("id").alias("doc_id"), F.lit(float(share)).alias("score"), F.col("x").alias("features")))
        trees = GBTClassifier(
            maxIter=rounds, maxDepth=depth, stepSize=0.3, seed=7, minInstancesPerNode=2
        ).fit(fitted.where("part < 80").coalesce(1))  # a bounded sample of numbers
        margin = VectorAssembler(inputCols=["probability"], outputCol="both")
        rest = fitted.where("part >= 80") if all(r.calibrate for r in classes) else fitted
        scale = IsotonicRegression(featuresCol="both", featureIndex=1, labelCol="label", predictionCol="even")
        curve = scale.fit(margin.transform(trees.transform(rest)))
        done = curve.transform(margin.transform(trees.transform(all_scored.withColumn("features", array_to_vector("x")))))
        # the calibrated value, and a thousandth of the trees' own to order equal ones
        blend = 0.999 * F.col("even") + 0.001 * F.element_at(vector_to_array("probability"), 2)
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), blend))
        return write_and_read(done.select(F.col("id").alias("doc_id"), score.alias("score"), F.col("x").alias("features")))
