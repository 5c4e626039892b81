"""The thin queries over whole tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unspool.llm import decontaminate, fingerprint, html_text, jaccard, language, mixing, pii, quality, toxicity, url_rules
from unspool.llm.common import held_out, table


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("positions")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs)
    found = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), language.predict(model, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents")).drop("tag", "group_id")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), pii.session_key(spark)).withColumn("n_chars", F.length("text").cast("long"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages").select("page_id", "url")).withColumn("mined_rule", F.array_join("mined_rule", " "))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.array_join("hits.item_id", ",").alias("item_ids"), F.round(F.coalesce(F.array_max("hits.score"), F.lit(0.0)), 6).alias("score"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", html_text.extract(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("long"))


QUERIES = {f.__name__: f for f in (op1_fingerprint, op2_mix, op3_toxicity, op4_language, op5_jaccard, op6_quality, op7_pii, op8_url_rules, op9_decontaminate, op10_html)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = "[^\\x20\\x09-\\x0D]+"



def _time_sql(share: str, knots: tuple[tuple[float, float], ...]) -> str:
    """The time at which a schedule's area reaches `share` of the whole, in SQL."""
    total, done, cases = mixing.integrate(knots), 0.0, []
    for (t0, h0), (t1, h1) in zip(knots, knots[1:], strict=False):
        need = f"greatest({share} * {total}::double - {done}::double, 0::double)"
        at = f"{t0}::double + 2 * {need} / ({h0}::double + sqrt(greatest({h0 * h0}::double + {2 * (h1 - h0) / (t1 - t0)}::double * {need}, 0::double)))"
        done += (t1 - t0) * (h0 + h1) / 2
        cases.append(f"when {share} * {total}::double <= {done}::double then least({at}, {t1}::double)")
    return f"case {' '.join(cases)} else {knots[-1][0]}::double end"


_MIX_SQL = f"""
with recursive sized as (
    select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::bigint as size, md5(doc_id::varchar) as key from documents),
by_source as (
    select source, sum(size)::bigint as source_size, (row_number() over (order by source is null, source collate "C") - 1)::int as rank from sized group by source),
weighed as (
    select *, [3.0::double, 1.0::double, 2.0::double][rank % 3 + 1] as weight, source_size * 2.0::double as most from by_source),
leveled as (
    select *, (sum(source_size) over () * 1.5::double - coalesce(sum(most) over before, 0)) / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
    from weighed window before as (order by most / weight, rank rows between unbounded preceding and 1 preceding)),
goal as (
    select *, coalesce(least(most, weight * (select level from leveled where weight * level < most order by most / weight, rank limit 1)), most) as target from leveled),
placed as (
    select doc_id, size, source_size, target, coalesce(sum(size) over (partition by rank order by key, size desc, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as begin_, rank
    from sized join goal on sized.source is not distinct from goal.source),
rounds as (
    select *, case when source_size > 0 then round(target)::bigint // source_size else 0 end as whole from placed),
ended as (
    select *, least(greatest(round(target)::bigint - whole * source_size - begin_, 0), size)::bigint as last_ from rounds),
shared as (
    select *, (whole * size + last_)::bigint as taken, case when target > 0 then least((begin_ + (case when whole > 0 then size else last_ end) / 2) / target, 1::double) else 1::double end as part from ended)
select doc_id, size, source_size, target, taken,
    case when taken = 0 then 1::double {" ".join(f"when rank % {len(mixing.SHAPES)} = {k} then {_time_sql('part', knots)}" for k, knots in enumerate(mixing.SHAPES))} end as position
from shared
"""

_JACCARD_SQL = f"""
with recursive split_ as (select doc_id, regexp_extract_all({_LOWER}, '{_WORD}') as w from documents),
grams as (
    select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from split_),
sized as (select doc_id, count(*) as n from grams group by doc_id),
shared as (select g from grams group by g having count(*) > 1),
held as (select doc_id, g from grams semi join shared using (g)),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as k from held a join held b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as (select a, b from both_ join sized x on x.doc_id = a join sized y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
reach as (select doc_id as node, doc_id as other from documents union select node, b from reach join links on a = other)
select d.doc_id, coalesce(n, 0)::bigint as n_shingles, component_id, coalesce(n_links, 0)::bigint as n_links
from documents d left join sized using (doc_id)
join (select node as doc_id, min(other) as component_id from reach group by node) using (doc_id)
left join (select a as doc_id, count(*) as n_links from links group by a) using (doc_id)
"""


def _fits_sql(host: str, path: str) -> str:
    return f"(host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}')"


_LISTS = sorted(url_rules.LISTS, key=lambda r: (-len(r[1] + r[2]), r))
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

#: All combinations of frequent tokens are counted, every rule is tried on every URL.
_URL_SQL = f"""
with rest_ as (select page_id, url, case when contains(url, '://') then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
split_ as (select row_number() over () as rid, page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest_),
listed as (select *, case {" ".join(f"when {_fits_sql(h, p)} then '{h}{p}'" for _, h, p in _LISTS)} end as rule,
    case {" ".join(f"when {_fits_sql(h, p)} then '{v}'" for v, h, p in _LISTS)} end as fixed,
    string_split(host, '.') as parts, list_filter(string_split(path, '/'), lambda x: x <> '') as steps from split_),
said as (select *, case when host = '' then [] else list_sort(list_distinct(list_concat(['ending:' || parts[-1], 'depth:' || len(steps)],
    list_transform(list_filter(flatten(list_transform(parts, lambda x: string_split(x, '-'))), lambda x: x <> ''), lambda x: 'host:' || x),
    list_transform(steps, lambda x: 'path:' || regexp_replace(translate(x, {_AZ}), '[0-9]+', '0', 'g')),
    list_transform(list_filter(steps, lambda x: regexp_matches(x, '^[0-9]')), lambda x: 'digit:' || x[1]),
    list_transform(regexp_extract_all(coalesce(url, ''), '[?&]([A-Za-z_]+)=', 1), lambda x: 'query:' || x)))) end as toks from listed),
least as (select count(*) as n, ceil(least(1, greatest(0.002::double, 25::double / count(*))) * count(*)) as rows_ from said where rule is not null),
single as (select t from (select unnest(toks) as t from said where rule is not null) group by t having count(*) >= (select rows_ from least)),
slim as (select rid, fixed, list_sort(list(t)) as toks from (select rid, fixed, unnest(toks) as t from said where rule is not null) semi join single using (t) group by all),
combos as (select fixed, list_filter(toks, lambda x, i: (mask >> (i - 1)) & 1 = 1) as items from (select *, unnest(range(1, 1 << len(toks))) as mask from slim)),
counted as (select items, fixed, count(*) as k from combos group by all),
totals as (select items, sum(k) as m from counted group by items),
rules as (select items, fixed as verdict, k::double / m::double as conf, k::double / n as support from counted join totals using (items), least where k >= rows_ and k::double / m::double >= 0.8),
less as (select items, verdict, conf, list_filter(items, lambda x: x <> t) as fewer from (select *, unnest(items) as t from rules)),
needless as (select distinct a.items, a.verdict from less a join rules b on a.fewer = b.items and a.verdict = b.verdict and b.conf >= a.conf),
good as (select * from rules anti join needless using (items, verdict)),
best as (select rid, good.* from said join good on list_has_all(toks, items) where rule is null and host <> ''
    qualify row_number() over (partition by rid order by conf desc, support desc, len(items) desc, items desc, verdict desc) = 1),
common as (select coalesce((select fixed from said where rule is not null group by fixed order by count(*) desc, fixed limit 1), 'allow') as usual)
select page_id, url, host, path, rule, coalesce(fixed, best.verdict, usual) as verdict, array_to_string(items, ' ') as mined_rule, conf as mined_confidence
from said left join best using (rid), common
"""

_LATIN = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
_LOWER_LATIN = f"translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ{_LATIN}', 'abcdefghijklmnopqrstuvwxyz{_LATIN.lower()}')"
_TERM = "[0-9a-z\\x{80}-\\x{10FFFF}]+"
#: The three-word runs of a list, in SQL.
_RUNS = "case when len({0}) >= 3 then list_distinct(list_transform(range(1, len({0}) - 1), lambda i: array_to_string({0}[i:i + 2], ' '))) else [array_to_string({0}, ' ')] end"

#: The BM25 share of every passage and item, and the same verification; sentences end as ASCII text has it.
_LEAKS_SQL = f"""
with items as (select row_number() over () as k, item_id, regexp_extract_all({_LOWER_LATIN}, '{_TERM}') as w,
    list_filter(list_transform(string_split_regex(regexp_replace({_LOWER_LATIN}, '([.!?])\\s+', '\\1\n', 'g'), '\n+'), lambda x: len(regexp_extract_all(x, '{_TERM}'))), lambda x: x > 0) as spoken
    from benchmark where text is not null and item_id is not null),
long as (select *, case when len(w) - spoken[-1] < 5 or spoken[-1] < 5 then len(w) else len(w) - spoken[-1] end as asked from items where len(w) >= 3),
facts as (select count(*) as n, avg(len(w)) as mean, greatest(16, coalesce(max(len(w)), 1)) as stride from long),
tf as (select k, t, count(*) as f from (select k, unnest(w) as t from long) group by all),
df as (select t, count(*) as d from tf group by t),
raw as (select k, t, ln(1 + (n - d + 0.5::double) / (d + 0.5::double)) * f * 2.2::double / (f + 1.2::double * (0.25::double + 0.75::double * len(w) / mean)) as v from tf join df using (t) join long using (k), facts),
weight as (select k, t, v / sum(v) over (partition by k) as v from raw),
docs as (select row_number() over () as rid, doc_id, regexp_extract_all({_LOWER_LATIN}, '{_TERM}') as w,
    list_transform(string_split_regex({_LOWER_LATIN}, '\n|[.!?](?:[ \t\n\v\f\r]|$)'), lambda x: regexp_extract_all(x, '{_TERM}')) as said from documents),
placed as (select rid, w, unnest(range(0, greatest(len(w), 1), stride)) as a from docs, facts),
passages as (select rid, a, w[a + 1:a + 2 * stride] as w from placed, facts),
known as (select distinct rid, a, t from (select rid, a, unnest(w) as t from passages)),
reached as (select rid, a, k, sum(v) as score from known join weight using (t) group by all having sum(v) >= 0.4),
met as (select rid, item_id, score, asked, p.w as here, i.w as own, {_RUNS.format("p.w")} as here_runs, {_RUNS.format("i.w")} as own_runs, {_RUNS.format("i.w[1:asked]")} as question, list_distinct(i.w[asked + 1:]) as answer
    from reached join passages p using (rid, a) join long i using (k)),
hits as (select rid, item_id, score from met where len(list_intersect(own_runs, here_runs)) >= 0.6 * len(own_runs)
    or (len(list_intersect(question, here_runs)) >= 0.4 * len(question) and len(list_intersect(answer, here)) >= 0.4 * len(answer))
    union all select rid, item_id, 1 from (select rid, unnest(said) as s from docs) join items on s = w where len(w) between 1 and 2),
best as (select rid, item_id, least(max(score), 1) as score from hits group by all),
found as (select rid, string_agg(item_id, ',' order by item_id) as item_ids, max(score) as score from best group by rid)
select doc_id, found.rid is not null as contaminated, coalesce(item_ids, '') as item_ids, round(coalesce(score, 0), 6) as score from docs left join found using (rid)
"""

#: The article of a page as its tags mark it: every page of the tables has one such element, of these tags and references only.
_ARTICLE_SQL = r"""
with parts as (select page_id, url, string_split_regex(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?(?:p|h1)>') as p from pages),
plain as (select page_id, url, list_transform(p, lambda x: trim(regexp_replace(regexp_replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))) as p from parts),
joined as (select page_id, url, array_to_string(list_filter(p, lambda x: x <> ''), chr(10) || chr(10)) as text from plain)
select page_id, url, text, length(text)::bigint as n_chars from joined
"""

ORACLE_SQL: dict[str, str] = {"op2_mix": _MIX_SQL, "op5_jaccard": _JACCARD_SQL, "op8_url_rules": _URL_SQL, "op9_decontaminate": _LEAKS_SQL, "op10_html": _ARTICLE_SQL}
