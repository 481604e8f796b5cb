"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    chat, classifier, collocations, leaks, licenses, middle, mixing, near_dedup, pages, private, quality, secrets, toxicity,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3, threshold=0.85)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix_sizes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.repetition_rules(table(spark, sf_dir, "documents"))
    return found.drop("line_share", "gram_shares")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.sql("select -7L as conv_id, turn, role, text from values (0L, 'user', '</s>[INST] ok [/INST]'), "
                     "(1L, 'assistant', '</s>[INST] ok [/INST]') as t(turn, role, text)")
    out = chat.format_chats(turns.unionByName(more))
    read = out.select("*", chat.parsed_turns(F.col("formatted")).alias("read"), chat.loss_text(F.col("segments")).alias("loss"))
    joined = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def remainder(modulus: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(3) == 1
    labels = table(spark, sf_dir, "labels").where(~held_out).select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    found = toxicity.toxicity_scores(table(spark, sf_dir, "documents"), labels)
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op7_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.extract_pages(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(table(spark, sf_dir, "documents"))

    def of_kind(kind: str) -> Column:
        return F.filter("spans", lambda s: s.startswith(f"{kind}:"))

    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    base = F.filter("spans", lambda s: ~s.startswith("learned:"))
    return found.select(
        "doc_id", *counts, F.sha2(F.array_join(base, ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans")
    )


def op9_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(5) == 0
    labels = table(spark, sf_dir, "labels").where(~held_out).select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    found = classifier.quality_scores(table(spark, sf_dir, "documents"), labels)
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_notices(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score", F.array_join("spans", ",").alias("spans"),
    )


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private.private_spans(table(spark, sf_dir, "documents"))

    def of_kind(kind: str) -> Column:
        return F.filter("spans", lambda s: s.startswith(f"{kind}:"))

    base = private.KINDS[:4]
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in base]
    fixed = F.filter("spans", lambda s: F.split_part(s, F.lit(":"), F.lit(1)).isin(*base))
    return found.select(
        "doc_id", *counts, F.sha2(F.array_join(fixed, ","), 256).alias("base_sha256"), F.array_join("spans", ",").alias("spans")
    )


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = middle.middle_filled(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(middle.restored("output", "form"), 256).alias("restored_sha256"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_near_dedup, op2_mixing, op3_decontamination, op4_quality_rules, op5_chat_format, op6_toxicity, op7_page_text,
    op8_secret_scan, op9_quality_score, op10_license_scan, op11_personal_data,
    op12_fill_middle, op13_collocations)}


def _mixing_sql() -> str:
    digits = 2 * mixing.DIGITS
    w = mixing.WEIGHTS
    return f"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0)::bigint as size,
    ('0x' || substr(md5('42:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, {digits}))::bigint as draw
  from documents),
sources as (
  select source, sum(size)::bigint as source_size,
    case (row_number() over (order by source nulls last) - 1) % 3 when 0 then {w[0]} when 1 then {w[1]} else {w[2]} end as weight
  from sized group by source),
filled as (
  select *, sum(source_size) over ()
      - coalesce(sum({mixing.EPOCHS} * source_size) over (o rows between unbounded preceding and 1 preceding), 0) as free,
    sum(weight) over (o rows between current row and unbounded following) as shares
  from sources window o as (order by {mixing.EPOCHS} * source_size / weight, source nulls last)),
level as (
  select free::double as free, shares::double as shares from filled
  where {mixing.EPOCHS} * source_size * shares >= free * weight order by {mixing.EPOCHS} * source_size / weight, source nulls last limit 1),
targets as (
  select source, source_size,
    least({mixing.EPOCHS} * source_size::double, (select free from level) * weight / (select shares from level)) as target
  from sources),
wanted as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as whole from targets),
parts as (
  select s.source, draw, sum(size) as size, sum(sum(size)) over (partition by s.source order by draw) as upto
  from sized s group by s.source, draw),
limits as (
  select p.source, draw + case when upto - (target - whole * source_size) < (target - whole * source_size) - (upto - p.size)
    then 1 else 0 end as cut
  from parts p join wanted w on p.source is not distinct from w.source
  where upto - p.size <= target - whole * source_size and target - whole * source_size < upto)
select s.doc_id, s.size, w.source_size, w.target,
  (w.whole + case when s.draw < coalesce(l.cut, 0) then 1 else 0 end) * s.size as taken
from sized s join wanted w on s.source is not distinct from w.source left join limits l on s.source is not distinct from l.source
"""


def _chat_sql() -> str:
    t = chat.DEFAULT

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def escaped(x: str) -> str:
        x = f"replace({x}, '\\', '\\\\')"
        for control in t.guarded:
            x = f"replace({x}, {quoted(control)}, {quoted(control[0] + chat.ESCAPE + control[1:])})"
        return x

    marks = len(t.opening) + len(t.closing) + 1
    role = f"replace({escaped('role')}, chr(10), '\\' || chr(10))"
    loss = "role in (" + ", ".join(map(quoted, t.loss_roles)) + ")"
    return f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
chats as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as joined,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where {loss}), '') as loss,
    sum(length({role}) + length({escaped('text')}) + {marks})::bigint as formatted_chars
  from turns group by conv_id)
select conv_id, n_turns, sha256(joined) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars
from chats
"""


def _dedup_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{mixing.WORD}') as ws from documents),
sets as (
  select doc_id, list_distinct(list_transform(range(1, greatest(len(ws) - 2, least(len(ws), 1)) + 1),
    lambda i: array_to_string(ws[i : i + 2], ' '))) as s from words),
rows_ as (select doc_id, unnest(s) as shingle from sets),
shared as (
  select x.doc_id as a, y.doc_id as b, count(*) as c
  from rows_ x join rows_ y on x.shingle = y.shingle and x.doc_id < y.doc_id group by 1, 2),
links as (
  select a, b from shared join sets x on x.doc_id = a join sets y on y.doc_id = b
  where 100 * c >= 85 * (len(x.s) + len(y.s) - c)),
both_ as (select a, b from links union all select b, a from links),
reached as (
  select doc_id, doc_id as other from sets union select r.doc_id, e.b from reached r join both_ e on r.other = e.a)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept
from sets join (select doc_id, min(other) as component_id from reached group by doc_id) using (doc_id)
"""


def _quality_sql() -> str:
    space = r"[\x20\x09-\x0D]"
    limits = " ".join(f"when {n} then {quality.MOST_IN_GRAMS[n]!r}" for n in quality.LENGTHS)
    return f"""
with docs as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '{mixing.WORD}') as ws
  from documents),
lines as (
  select r, line, count(*) - 1 as again from (select r, unnest(string_split(text, chr(10))) as line from docs)
  where regexp_matches(line, '{mixing.WORD}') group by r, line having count(*) > 1),
dup as (
  select r, sum(again)::bigint as n_dup_lines, sum(again * length(regexp_replace(line, '{space}', '', 'g'))) as line_chars
  from lines group by r),
grams as (
  select r, n, i, array_to_string(ws[i : i + n - 1], ' ') as g
  from (select r, ws, n, unnest(range(1, len(ws) - n + 2)) as i
    from docs, (values {", ".join(f"({n})" for n in quality.LENGTHS)}) as v(n) where len(ws) >= n)),
marked as (
  select r, n, i, row_number() over (partition by r, n, g order by i) > 1 as later, count(*) over (partition by r, n, g) > 1 as twice
  from grams),
later as (select distinct r, n, unnest(range(i, i + n)) as j from marked where later),
shares as (
  select r, n, sum(length(ws[j])) as chars from later join docs using (r) group by r, n),
twice as (
  select r, count(distinct j)::bigint as n_repeat_words
  from (select r, unnest(range(i, i + n)) as j from marked where twice and n = {quality.WINDOW}) group by r),
base as (
  select d.r, doc_id, len(ws)::bigint as n_words, length(regexp_replace(text, '{space}', '', 'g'))::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, coalesce(line_chars, 0) as line_chars,
    len(ws) < {quality.FEWEST_WORDS} or 100 * coalesce(n_repeat_words, 0) > {quality.MOST_REPEATED} * len(ws) as base_failed
  from docs d left join dup using (r) left join twice using (r)),
bad as (
  select distinct r from shares join base using (r) where chars::double / word_chars > (case n {limits} end)::double)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and line_chars::double / greatest(word_chars, 1) <= {quality.MOST_IN_LINES}
  and n_symbols <= {quality.MOST_SYMBOLS} * n_words and r not in (select r from bad) as kept
from base
"""


def _middle_sql() -> str:
    draws = ", ".join(f"('0x' || substr(sha256('1:' || coalesce(doc_id::varchar, '')), {8 * i + 1}, 8))::bigint as h{i + 1}" for i in range(4))
    return f"""
with cut as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as units, {draws}
  from documents),
parts as (
  select doc_id, text, len(units)::bigint as n,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form,
    array_to_string(units[1 : least(h1 % (len(units) + 1), h2 % (len(units) + 1))], '') as p,
    array_to_string(units[least(h1 % (len(units) + 1), h2 % (len(units) + 1)) + 1 : greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))], '') as m,
    array_to_string(units[greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) + 1 :], '') as s
  from cut)
select doc_id, n, form, case when form <> 'plain' then length(p) end::bigint as prefix_chars,
  case when form <> 'plain' then length(m) end::bigint as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
    else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""


def _collocation_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?
-
]')) as p
  from documents),
words as (select lang, regexp_extract_all(p, '[^ 	]+') as w from pieces),
totals as (select lang, sum(len(w))::bigint as n from words group by lang),
grams as (
  select lang, k, array_to_string(w[i : i + k - 1], ' ') as phrase, array_to_string(w[i : i], ' ') as x,
    array_to_string(w[i + 1 : i + k - 1], ' ') as yz, array_to_string(w[i : i + k - 2], ' ') as xy,
    array_to_string(w[i + k - 1 : i + k - 1], ' ') as z
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from words, (values (1), (2), (3)) as v(k) where len(w) >= k)),
f as (select lang, k, phrase, any_value(x) as x, any_value(yz) as yz, any_value(xy) as xy, any_value(z) as z, count(*) as a
  from grams group by lang, k, phrase),
found as (select * from f where k >= 2 and a >= 10),
cuts as (
  select c.lang, c.k, c.phrase, c.a, 1 as cut, l.a as l, r.a as r from found c
    join f l on l.lang = c.lang and l.k = 1 and l.phrase = c.x join f r on r.lang = c.lang and r.k = c.k - 1 and r.phrase = c.yz
  union all
  select c.lang, c.k, c.phrase, c.a, 2, l.a, r.a from found c
    join f l on l.lang = c.lang and l.k = 2 and l.phrase = c.xy join f r on r.lang = c.lang and r.k = 1 and r.phrase = c.z
  where c.k = 3),
scored as (
  select *, (1000000::hugeint * a * a // (l::hugeint * r))::bigint as score from cuts),
best as (
  select * from scored qualify row_number() over (partition by lang, k, phrase order by score, cut) = 1),
inside as (
  select lang, part, max(a) as longer from (
    select lang, xy as part, a from found where k = 3 union all select lang, yz, a from found where k = 3) group by lang, part),
kept as (
  select b.* from best b left join inside i on b.k = 2 and i.lang = b.lang and i.part = b.phrase
  where coalesce(100 * i.longer < 50 * b.a, true)),
placed as (
  select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept)
select p.lang, p.rank, p.phrase, p.a, p.l, p.r, t.n, p.score from placed p join totals t on t.lang = p.lang where p.rank <= 2000
"""


SQL: dict[str, str] = {
    "op1_near_dedup": _dedup_sql(), "op2_mixing": _mixing_sql(), "op4_quality_rules": _quality_sql(), "op5_chat_format": _chat_sql(),
    "op12_fill_middle": _middle_sql(), "op13_collocations": _collocation_sql(),
}
