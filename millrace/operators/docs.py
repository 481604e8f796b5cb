"""Document text preparation and nested analysis records."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.operators.text import SPACE

# Fixed values.
DROPPED_TAGS = ("script", "style", "nav", "footer")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&copy;", "©"),
            ("&middot;", "·"), ("&amp;", "&"))
PREVIEW_CHARS = 1_500
REQUEST_CHARS = 12_000
CATEGORIES = ("Accreditation", "Scholarship", "Curriculum", "Faculty Policy", "Examination", "Admissions",
              "Institutional Governance", "Other")

ANALYSIS_SCHEMA = """
topic_category STRING, easy_summary STRING,
chronology_history ARRAY<STRUCT<year_or_phase: STRING, event: STRING>>,
stakeholder_impact STRUCT<students: STRING, faculty: STRING, institutions: STRING, administrators: STRING,
    accreditation_compliance_teams: STRING>,
sentiment_and_risk STRUCT<controversial_areas: STRING, implementation_bottlenecks: STRING>,
timeframe_impact STRUCT<short_term: STRING, medium_term: STRING, long_term: STRING>,
positives ARRAY<STRING>, negatives ARRAY<STRING>
"""

# Flat column -> (path in the record, text shown when it is missing).
FIELDS = {
    "category": ("topic_category", "Unclassified"),
    "summary": ("easy_summary", "No summary generated."),
    "students": ("stakeholder_impact.students", "N/A"),
    "faculty": ("stakeholder_impact.faculty", "N/A"),
    "institutions": ("stakeholder_impact.institutions", "N/A"),
    "administrators": ("stakeholder_impact.administrators", "N/A"),
    "compliance_teams": ("stakeholder_impact.accreditation_compliance_teams", "N/A"),
    "controversial_areas": ("sentiment_and_risk.controversial_areas", "None detected"),
    "bottlenecks": ("sentiment_and_risk.implementation_bottlenecks", "None detected"),
    "short_term": ("timeframe_impact.short_term", "N/A"),
    "medium_term": ("timeframe_impact.medium_term", "N/A"),
    "long_term": ("timeframe_impact.long_term", "N/A"),
}

# Report lines as (section, heading, label, path).
REPORT = (
    (0, "Report", "Category", "topic_category"),
    (1, "Executive Summary", "Summary", "easy_summary"),
    (2, "Stakeholder Impact", "Students", "stakeholder_impact.students"),
    (2, "Stakeholder Impact", "Faculty", "stakeholder_impact.faculty"),
    (2, "Stakeholder Impact", "Institutions", "stakeholder_impact.institutions"),
    (2, "Stakeholder Impact", "Administrators", "stakeholder_impact.administrators"),
    (3, "Timeframe", "Short Term (0-1 yr)", "timeframe_impact.short_term"),
    (3, "Timeframe", "Medium Term (1-5 yrs)", "timeframe_impact.medium_term"),
    (3, "Timeframe", "Long Term (>5 yrs)", "timeframe_impact.long_term"),
)

INSTRUCTION = (
    "Read the policy document below and answer with one JSON object that has these fields: topic_category (one of "
    + ", ".join(CATEGORIES)
    + "), easy_summary, chronology_history, stakeholder_impact, sentiment_and_risk, timeframe_impact, positives and "
    "negatives. Document:\n"
)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text -------------------------------------------------------------------------------------------------

def clean_text(c: str | Column) -> Column:
    """Every run of white space, line breaks included, becomes one space; ends trimmed."""
    return F.trim(F.regexp_replace(_col(c), SPACE, " "))


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(html.unescape, na_action="ignore")


def html_text(c: str | Column, every_entity: bool = True) -> Column:
    """Visible text of a page: no script, style, nav, footer, comment or tag; entities decoded; spaces collapsed.

    All entities are decoded, in an Arrow UDF; with ``every_entity=False`` only the common ones, by built-in functions.
    """
    out = _col(c)
    for tag in DROPPED_TAGS:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    out = F.regexp_replace(out, r"(?s)<!--.*?-->", "")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "\n")
    if every_entity:
        out = _unescape(out)
    else:
        for name, char in ENTITIES:
            out = F.replace(out, F.lit(name), F.lit(char))
    return clean_text(out)


def assemble_pieces(df: DataFrame, key: str, order: str, text: str, skip_blank: bool = False) -> DataFrame:
    """(key, text): a document's pieces in order, one per line, empty ones left out (blank ones too if asked)."""
    kept = F.col(text) != ""
    if skip_blank:
        kept = kept & (clean_text(text) != "")
    pieces = df.filter(kept).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_p"))
    return pieces.select(key, F.array_join(F.transform("_p", lambda p: p[text]), "\n").alias(text))


def word_count(c: str | Column) -> Column:
    """White-space separated words; 0 for an empty text."""
    return F.size(F.filter(F.split(_col(c), SPACE), lambda w: w != ""))


def preview(c: str | Column, n: int = PREVIEW_CHARS) -> Column:
    """First ``n`` characters, with ``...`` when there are more."""
    c = _col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def analysis_requests(
    df: DataFrame, key: str, text: str, instruction: str = INSTRUCTION, limit: int = REQUEST_CHARS
) -> DataFrame:
    """(key, part, request): the instruction followed by consecutive parts of a document of at most ``limit`` characters,
    the most a service takes at once; part 0 alone for short and empty texts, none for a null text."""
    text = F.col(text)
    last = F.greatest(F.lit(0), F.ceil(F.length(text) / limit).cast("int") - 1)
    parts = df.where(text.isNotNull()).select(key, text.alias("_text"), F.explode(F.sequence(F.lit(0), last)).alias("part"))
    request = F.concat(F.lit(instruction), F.substring(F.col("_text"), F.col("part") * limit + 1, F.lit(limit)))
    return parts.select(key, "part", request.alias("request"))


def enrich(
    df: DataFrame, make_client: Callable[[], Callable[[pd.Series], Sequence[str]]], text: str, key: str,
    name: str = "response",
) -> DataFrame:
    """(key, response): a caller-supplied service applied in Arrow batches, one client per partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for pdf in frames:
            yield pd.DataFrame({key: pdf[key], name: list(client(pdf[text]))})

    schema = T.StructType([df.schema[key], T.StructField(name, T.StringType())])
    return df.select(key, text).mapInPandas(run, schema)


# --- analysis records -------------------------------------------------------------------------------------

def parse_analysis(df: DataFrame, column: str = "response") -> DataFrame:
    """Add ``record`` (the nested analysis) and ``error`` (the raw text when it is not valid JSON)."""
    schema = ANALYSIS_SCHEMA + ", _bad STRING"
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    parsed = F.from_json(column, schema, options)
    return df.withColumn("record", parsed).withColumn("error", F.col("record._bad")).withColumn(
        "record", F.col("record").dropFields("_bad")
    )


def analysis_fields(parsed: DataFrame, key: str) -> DataFrame:
    """Flat fields with their defaults; a JSON null counts as missing."""
    return parsed.select(
        key, *[F.coalesce(F.col(f"record.{p}"), F.lit(d)).alias(name) for name, (p, d) in FIELDS.items()]
    )


def chronology(parsed: DataFrame, key: str) -> DataFrame:
    """(key, seq, phase, event); documents without history have no rows."""
    items = parsed.select(key, F.posexplode("record.chronology_history").alias("seq", "_i"))
    return items.select(
        key, "seq", F.coalesce("_i.year_or_phase", F.lit("Past Event")).alias("phase"),
        F.coalesce("_i.event", F.lit("N/A")).alias("event"),
    )


def pros_cons(parsed: DataFrame, key: str) -> DataFrame:
    """(key, side, seq, point)."""
    sides = [
        parsed.select(key, F.lit(side).alias("side"), F.posexplode(f"record.{path}").alias("seq", "point"))
        for side, path in (("positive", "positives"), ("negative", "negatives"))
    ]
    return sides[0].unionByName(sides[1])


def category_counts(parsed: DataFrame, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """(category, n); anything off the list counts as ``Other``."""
    c = F.col("record.topic_category")
    known = F.when(c.isin(*categories), c).otherwise("Other")
    return parsed.groupBy(known.alias("category")).agg(F.count("*").alias("n"))


def report_rows(parsed: DataFrame, key: str) -> DataFrame:
    """(key, line, section, heading, label, text) in report order; missing text is ``N/A``."""
    lines = [
        F.struct(
            F.lit(i).alias("line"), F.lit(section).alias("section"), F.lit(heading).alias("heading"),
            F.lit(label).alias("label"), F.coalesce(F.col(f"record.{path}"), F.lit("N/A")).alias("text"),
        )
        for i, (section, heading, label, path) in enumerate(REPORT)
    ]
    return parsed.select(key, F.inline(F.array(*lines)))
