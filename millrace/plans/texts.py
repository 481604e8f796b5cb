"""Text similarity and document queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import functions as fn
from millrace.operators import docs, text
from millrace.plans import sqltext as q
from millrace.plans.fixtures import view

QUERIES: dict = {}
SQL: dict = {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return register


def r6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def stories(spark, sf):
    return view(spark, sf, "movies").select("row_id", "title", F.coalesce("storyline", F.lit("")).alias("storyline"))


# --- cleaning ---------------------------------------------------------------------------------------------

@query("normalize_text", f"select row_id, {q.normalized('storyline')} as story from movies")
def normalize_text(spark, sf):
    return view(spark, sf, "movies").select("row_id", text.normalize_text("storyline").alias("story"))


STORY = q.normalized("storyline")


@query("tokens", f"select row_id, array_to_string({q.token_list(STORY)}, ' ') as tokens from movies")
def tokens(spark, sf):
    words = text.tokens(text.normalize_text("storyline"))
    return view(spark, sf, "movies").select("row_id", F.array_join(words, " ").alias("tokens"))


@query("remove_stopwords", f"select row_id, array_to_string({q.without_stop_words(q.token_list(STORY))}, ' ') as kept from movies")
def remove_stopwords(spark, sf):
    words = text.remove_stop_words(text.tokens(text.normalize_text("storyline")))
    return view(spark, sf, "movies").select("row_id", F.array_join(words, " ").alias("kept"))


@query("lemmatize", f"select row_id, array_to_string({q.nouns(q.without_stop_words(q.token_list(STORY)))}, ' ') as story from movies")
def lemmatize(spark, sf):
    return view(spark, sf, "movies").select("row_id", text.clean_story("storyline").alias("story"))


# --- TF-IDF -----------------------------------------------------------------------------------------------

POSTINGS = f"""stories as (select row_id, title, coalesce(storyline, '') as storyline from movies),
    posted as (select row_id, term, count(*) as tf from (select row_id, unnest({q.term_list('storyline')}) as term from stories)
    group by row_id, term),
    freq as (select term, count(*) as df, ln((1.0 + (select count(*) from stories)) / (1.0 + count(*))) + 1 as idf
    from posted group by term),
    raw as (select row_id, term, tf, df, tf * idf as w from posted join freq using (term)),
    weights as (select row_id, term, tf, df, w / sqrt(sum(w * w) over (partition by row_id)) as weight from raw)"""


@query("tfidf", f"with {POSTINGS} select row_id, term, tf, df, round(weight, 6) as weight from weights")
def tfidf(spark, sf):
    return r6(text.tfidf(stories(spark, sf), "row_id", "storyline"), "weight")


@query("corpus_shape", f"with {POSTINGS} select (select count(*) from stories) as documents, (select count(*) from freq) as vocabulary")
def corpus_shape(spark, sf):
    return text.corpus_shape(stories(spark, sf), "row_id", "storyline")


@query("text_copies", "select min(doc_id) as doc_id, count(*) as n_copies from documents group by coalesce(text, '')")
def text_copies(spark, sf):
    return text.text_copies(view(spark, sf, "documents"), "doc_id", "text")


@query("cosine_pairs", f"""with {POSTINGS}, groups as (select min(row_id) as row_id, count(*) as n_copies from stories
    group by storyline), lone as (select w.*, n_copies from weights w join groups using (row_id)),
    pairs as (select a.row_id as a, b.row_id as b, a.n_copies as n_a, b.n_copies as n_b, sum(a.weight * b.weight) as score
    from lone a join lone b on a.term = b.term and a.row_id < b.row_id group by 1, 2, 3, 4)
    select a, b, n_a, n_b, round(score, 6) as score from pairs where round(score, 9) >= 0.5""")
def cosine_pairs(spark, sf):
    return r6(text.cosine_pairs(stories(spark, sf), "row_id", "storyline", 0.5), "score")


@query("copy_groups", """select d.doc_id, representative from documents d join (select min(doc_id) as representative, coalesce(text, '') as t
    from documents group by 2) g on coalesce(d.text, '') = g.t""")
def copy_groups(spark, sf):
    return text.copy_groups(view(spark, sf, "documents"), "doc_id", "text")


@query("title_lookup", """select regexp_replace(lower(title), '^\\s+|\\s+$', '', 'g') as title_key, min(row_id) as row_id
    from movies group by 1""")
def title_lookup(spark, sf):
    return text.title_index(view(spark, sf, "movies"), "row_id", "title")


@query("similar_docs", f"""with {POSTINGS}, seed as (select min(row_id) as id from stories where trim(lower(title)) = 'film 7'),
    hits as (select b.row_id, sum(a.weight * b.weight) as score from weights a join weights b on a.term = b.term
    where a.row_id = (select id from seed) group by b.row_id),
    ranked as (select s.row_id, s.title, coalesce(score, 0) as score, row_number() over
    (order by round(coalesce(score, 0), 9) desc, s.row_id) as rank from stories s left join hits using (row_id)
    where s.row_id <> (select id from seed))
    select row_id, title, cast(rank as int) as rank, round(score, 6) as score,
    printf('%.1f%%', round(score * 100, 1)) as match_score from ranked where rank <= 10""")
def similar_docs(spark, sf):
    rows = stories(spark, sf)
    seed = text.find_title(rows, "row_id", "title", "Film 7")
    best = text.similar_docs(rows, seed, "row_id", "storyline", 10)
    named = best.join(rows.select("row_id", "title"), "row_id")
    return r6(named.select("row_id", "title", "rank", "score", fn.percent_label("score").alias("match_score")), "score")


@query("match_text", f"""with {POSTINGS}, asked as (select item_id, term, count(*) as tf from (select item_id,
    unnest({q.term_list(q.normalized('text'))}) as term from benchmark) group by 1, 2),
    aw as (select item_id, term, tf * idf as w from asked join freq using (term)),
    au as (select item_id, term, w / sqrt(sum(w * w) over (partition by item_id)) as weight from aw),
    hits as (select item_id, b.row_id, sum(a.weight * b.weight) as score from au a join weights b on a.term = b.term group by 1, 2),
    ranked as (select i.item_id, s.row_id, coalesce(score, 0) as score, row_number() over (partition by i.item_id
    order by round(coalesce(score, 0), 9) desc, s.row_id) as rank from benchmark i join stories s on true
    left join hits h on h.item_id = i.item_id and h.row_id = s.row_id)
    select item_id, row_id, cast(rank as int) as rank, round(score, 6) as score from ranked where rank <= 5""")
def match_text(spark, sf):
    asked = view(spark, sf, "benchmark").select("item_id", text.normalize_text("text").alias("plot"))
    out = text.match_text(stories(spark, sf), asked, "row_id", "storyline", "item_id", "plot", 5)
    return r6(out.select(F.col("query_id").alias("item_id"), "row_id", "rank", "score"), "score")


# --- documents --------------------------------------------------------------------------------------------

@query("html_text", f"select page_id, {q.page_text('html')} as text from pages")
def html_text(spark, sf):
    return view(spark, sf, "pages").select("page_id", docs.html_text("html").alias("text"))


@query("clean_text", f"select doc_id, {q.cleaned('text')} as text from documents")
def clean_text(spark, sf):
    return view(spark, sf, "documents").select("doc_id", docs.clean_text("text").alias("text"))


@query("assemble_pieces", """select conv_id, string_agg(text, chr(10) order by turn, text) as text from conversations
    where text <> '' group by conv_id""")
def assemble_pieces(spark, sf):
    return docs.assemble_pieces(view(spark, sf, "conversations"), "conv_id", "turn", "text")


@query("word_count", f"""select doc_id, n_words, case when n_words = 0 then 1 else 0 end as is_blank from (select doc_id,
    cast(len(list_filter(string_split({q.cleaned('text')}, ' '), lambda w: w <> '')) as int) as n_words from documents)""")
def word_count(spark, sf):
    counted = view(spark, sf, "documents").select("doc_id", docs.word_count("text").alias("n_words"))
    return counted.withColumn("is_blank", F.when(F.col("n_words") == 0, 1).otherwise(0))


@query("preview", "select doc_id, case when length(text) > 1500 then concat(substring(text, 1, 1500), '...') else text end "
       "as preview from documents")
def preview(spark, sf):
    return view(spark, sf, "documents").select("doc_id", docs.preview("text").alias("preview"))


@query("analysis_request", f"""select doc_id, part::int as part, concat({q.quoted(docs.INSTRUCTION)},
    substring(text, part * {docs.REQUEST_CHARS} + 1, {docs.REQUEST_CHARS})) as request from (select doc_id, text,
    unnest(range(greatest(1, (length(text) + {docs.REQUEST_CHARS} - 1) // {docs.REQUEST_CHARS}))) as part from documents where text is not null)""")
def analysis_request(spark, sf):
    return docs.analysis_requests(view(spark, sf, "documents"), "doc_id", "text")


@query("enrich_records", """select d.doc_id, d.lang, case when json_valid(a.response) then
    json_extract_string(a.response, '$.topic_category') end as category from documents d
    left join analysis_json a on a.doc_id = d.doc_id""")
def enrich_records(spark, sf):
    """Documents with the fields of the responses that a service has given for them."""
    answers = analysis(spark, sf).select("doc_id", F.col("record.topic_category").alias("category"))
    return view(spark, sf, "documents").select("doc_id", "lang").join(answers, "doc_id", "left")


def analysis(spark, sf):
    return docs.parse_analysis(view(spark, sf, "analysis_json"))


ANALYSIS = "good as (select doc_id, response, case when json_valid(response) then response end as j from analysis_json)"


def at(path):
    return f"json_extract_string(j, '$.{path}')"


def field(path, default):
    return f"coalesce({at(path)}, {q.quoted(default)})"


@query("parse_analysis", f"""with {ANALYSIS} select doc_id, {at('topic_category')} as category, {at('stakeholder_impact.students')}
    as students, cast(json_array_length(j, '$.positives') as int) as n_positives,
    case when j is null then response end as error from good""")
def parse_analysis(spark, sf):
    return analysis(spark, sf).select(
        "doc_id", F.col("record.topic_category").alias("category"),
        F.col("record.stakeholder_impact.students").alias("students"),
        F.size("record.positives").alias("n_positives"), "error",
    )


@query("analysis_fields", f"with {ANALYSIS} select doc_id, "
       + ", ".join(f"{field(p, d)} as {name}" for name, (p, d) in docs.FIELDS.items()) + " from good")
def analysis_fields(spark, sf):
    return docs.analysis_fields(analysis(spark, sf), "doc_id")


@query("chronology", f"""with {ANALYSIS}, items as (select doc_id, cast(i as int) as seq, json_extract(j,
    concat('$.chronology_history[', cast(i as varchar), ']')) as e
    from good, unnest(range(0, cast(coalesce(json_array_length(j, '$.chronology_history'), 0) as bigint))) as r(i))
    select doc_id, seq, coalesce(json_extract_string(e, '$.year_or_phase'), 'Past Event') as phase,
    coalesce(json_extract_string(e, '$.event'), 'N/A') as event from items""")
def chronology(spark, sf):
    return docs.chronology(analysis(spark, sf), "doc_id")


@query("pros_cons", f"with {ANALYSIS} " + " union all ".join(
    f"""select doc_id, '{side}' as side, cast(i as int) as seq, json_extract_string(j, concat('$.{path}[', cast(i as varchar),
    ']')) as point from good, unnest(range(0, cast(coalesce(json_array_length(j, '$.{path}'), 0) as bigint))) as r(i)"""
    for side, path in (("positive", "positives"), ("negative", "negatives"))))
def pros_cons(spark, sf):
    return docs.pros_cons(analysis(spark, sf), "doc_id")


@query("category_counts", f"""with {ANALYSIS} select case when {at('topic_category')} in ({', '.join(q.quoted(c)
    for c in docs.CATEGORIES)}) then {at('topic_category')} else 'Other' end as category, count(*) as n from good group by 1""")
def category_counts(spark, sf):
    return docs.category_counts(analysis(spark, sf))


@query("report_rows", f"with {ANALYSIS} " + " union all ".join(
    f"""select doc_id, {i} as line, {section} as section, '{heading}' as heading, '{label}' as label,
    {field(path, 'N/A')} as text from good""" for i, (section, heading, label, path) in enumerate(docs.REPORT)))
def report_rows(spark, sf):
    return docs.report_rows(analysis(spark, sf), "doc_id")
