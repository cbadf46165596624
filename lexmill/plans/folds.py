"""Ordered folds, clause extraction, run logs and streams on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import segments as S
from lexmill.functions import words as W
from lexmill.operators import chunking as C
from lexmill.operators import ranking as R
from lexmill.plans.base import chunks, documents, evidence, judged
from lexmill.plans.ranking import bm25_sql
from lexmill.plans.registry import DOCS, EVIDENCE, JUDGED, RECORDS, named
from lexmill.plans.text import _sentences_sql
from lexmill.tables import read


@named(
    r"""with recursive d as (select doc_id, max(text) as text from documents where doc_id is not null and text is not null group by doc_id),
    p as (select doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') as parts from d),
    f(doc_id, parts, i, cur, done) as (select doc_id, parts, 1::bigint, '', []::varchar[] from p union all
    select doc_id, parts, i + 1, case when length(cur) + length(parts[i]) > 400 and cur <> '' then parts[i] when cur = '' then parts[i] else cur || chr(10) || chr(10) || parts[i] end,
    case when length(cur) + length(parts[i]) > 400 and cur <> '' then list_append(done, cur) else done end from f where i <= len(parts)),
    o as (select doc_id, case when cur = '' then done else list_append(done, cur) end as packs from f where i = len(parts) + 1)
    select doc_id, cast(len(packs) as int) as packs, packs[1] as head, packs[-1] as tail from o where len(packs) > 0"""
)
def paragraph_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs packed up to 400 characters: number, first and last pack."""
    d = documents(spark, sf_dir).select("doc_id", S.pack(S.paragraphs(F.col("text")), 400).alias("p")).where(F.size("p") > 0)
    return d.select("doc_id", F.size("p").alias("packs"), F.element_at("p", 1).alias("head"), F.element_at("p", -1).alias("tail"))


# Likeness of neighbouring sentences by shared words, exact in both engines.
@named(
    r"""with recursive d as (select user_id, list(round(value, 6) order by event_id) as likeness from events where value is not null and user_id is not null group by user_id),
    t as (select user_id, likeness, quantile_cont(x, 0.25) as thr from (select user_id, likeness, unnest(likeness) as x from d) group by user_id, likeness),
    f(user_id, likeness, thr, i, last, breaks) as (select user_id, likeness, thr, 0::bigint, 0::bigint, []::bigint[] from t union all
    select user_id, likeness, thr, i + 1, case when likeness[i + 1] < thr and i - last >= 3 then i + 1 else last end, case when likeness[i + 1] < thr and i - last >= 3 then list_append(breaks, i + 1) else breaks end
    from f where i < len(likeness))
    select user_id, cast(len(breaks) as int) as n, array_to_string(breaks, ',') as breaks from f where i = len(likeness)"""
)
def breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Breaks where a series falls under its own lower quartile, at least three apart."""
    d = read(spark, sf_dir, "events").where("value is not null and user_id is not null")
    d = d.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.round("value", 6).alias("v")))).alias("l"), F.percentile(F.round("value", 6), 0.25).alias("thr"))
    out = d.select("user_id", S.breakpoints(F.transform("l", lambda x: x["v"]), F.col("thr")).alias("b"))
    return out.select("user_id", F.size("b").alias("n"), F.array_join(F.transform("b", lambda x: x.cast("string")), ",").alias("breaks"))


MAX = 256
_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '(?m)^\d+\s*$|^\(NY\)\s+\d+/.*\.doc\s*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_SPLIT = r"list_filter(string_split(trim(regexp_replace({0}, '\s+', ' ', 'g')), ' '), lambda w: w <> '')"
_TOKENS = "cast(floor(len({0}) * 1.4::double) as int)"


@named(
    rf"""with recursive {DOCS}, c as (select doc_id, {_CLEAN} as t from docs), s as (select doc_id, s from (select doc_id, {_sentences_sql('t')} as s from c) where len(s) > 0),
    w as (select doc_id, s, list_transform(s, lambda x: list_distinct({_SPLIT.format('lower(x)')})) as w from s),
    l as (select doc_id, s, list_transform(range(1, len(s)), lambda i: round(len(list_intersect(w[i], w[i + 1])) / sqrt(greatest(len(w[i]) * len(w[i + 1]), 1)::double), 6)) as likes from w),
    o as (select doc_id, s, likes, list_sort(likes) as o, (len(likes) - 1) * 0.25::double as p from l),
    q as (select doc_id, s, likes, o[floor(p)::bigint + 1] + (coalesce(o[floor(p)::bigint + 2], o[floor(p)::bigint + 1]) - o[floor(p)::bigint + 1]) * (p - floor(p)) as thr from o),
    rb(doc_id, i, last, breaks) as (select doc_id, 0::bigint, 0::bigint, []::bigint[] from q union all select rb.doc_id, i + 1, case when likes[i + 1] < thr and i - last >= 3 then i + 1 else last end,
    case when likes[i + 1] < thr and i - last >= 3 then list_append(breaks, i + 1) else breaks end from rb join q on q.doc_id = rb.doc_id where i < len(likes)),
    cuts as (select q.doc_id, s, list_concat([0::bigint], breaks, [len(s)::bigint]) as cuts from rb join q on q.doc_id = rb.doc_id where i = len(likes) and len(s) > 3),
    seg as (select doc_id, k, array_to_string(s[cuts[k + 1] + 1 : cuts[k + 2]], ' ') as text from (select doc_id, s, cuts, unnest(range(0, len(cuts) - 1)) as k from cuts)),
    sized as (select doc_id, k, text, {_TOKENS.format(_SPLIT.format('text'))} > {MAX} as big from seg),
    cl as (select doc_id, k, unnest(l) as c, unnest(range(1, len(l) + 1)) as j from (select doc_id, k, string_split(regexp_replace(text, '([.;])\s+', '\1' || chr(31), 'g'), chr(31)) as l from sized where big)),
    cw as (select doc_id, k, j, c, {_SPLIT.format('c')} as w from cl),
    un as (select doc_id, k, j, 0::bigint as m, c as unit from cw where {_TOKENS.format('w')} <= {MAX}
    union all select doc_id, k, j, m, array_to_string(w[m * 149 + 1 : m * 149 + 164], ' ') from (select *, unnest(range(0, 1 + cast(greatest(0, ceil((len(w) - 164) / 149.0)) as bigint))) as m from cw where {_TOKENS.format('w')} > {MAX})),
    ul as (select doc_id, k, list(unit order by j, m) as units, list({_TOKENS.format(_SPLIT.format('unit'))} order by j, m) as sizes from un group by doc_id, k),
    pk(doc_id, k, i, lo, total, cut) as (select doc_id, k, 0::bigint, 0::bigint, 0::bigint, []::bigint[][] from ul union all
    select doc_id, k, i + 1, case when new then i - back else lo end, case when new then case when back = 1 then before else 0 end else total end + here, case when new then list_append(cut, [lo, i]) else cut end
    from (select pk.*, sizes[i + 1] as here, sizes[i] as before, i > lo and total + sizes[i + 1] > {MAX} as new, case when i > lo and sizes[i] <= {MAX // 4} then 1 else 0 end as back from pk join ul on ul.doc_id = pk.doc_id and ul.k = pk.k where i < len(sizes))),
    pt as (select pk.doc_id, pk.k, list_append(cut, [lo, i]) as cut, units from pk join ul on ul.doc_id = pk.doc_id and ul.k = pk.k where i = len(units)),
    it as (select doc_id, k, 0::bigint as j, text, false as fresh from sized where not big union all select doc_id, k, j, array_to_string(units[cut[j][1] + 1 : cut[j][2]], ' '), true from (select *, unnest(range(1, len(cut) + 1)) as j from pt)),
    ml as (select doc_id, list(text order by k, j) as texts, list(len({_SPLIT.format('text')}) order by k, j) as sizes, list(fresh order by k, j) as fresh from it group by doc_id),
    mg(doc_id, i, lo, total, cut) as (select doc_id, 0::bigint, 0::bigint, 0::bigint, []::bigint[][] from ml union all select doc_id, i + 1, case when new then i else lo end, case when new then 0 else total end + here, case when new then list_append(cut, [lo, i]) else cut end
    from (select mg.*, sizes[i + 1] as here, i > lo and (total + sizes[i + 1] > {C.most_words(MAX)} or fresh[i + 1]) as new from mg join ml on ml.doc_id = mg.doc_id where i < len(sizes))),
    fin as (select mg.doc_id, list_append(cut, [lo, i]) as cut, texts from mg join ml on ml.doc_id = mg.doc_id where i = len(texts)),
    ch as (select doc_id, j, array_to_string(texts[cut[j][1] + 1 : cut[j][2]], ' ') as text from (select *, unnest(range(1, len(cut) + 1)) as j from fin)),
    out_ as (select doc_id, cast(row_number() over (partition by doc_id order by j) - 1 as int) as chunk, 'semantic' as chunk_type, text from ch where len({_SPLIT.format('text')}) >= 5
    union all select doc_id, 0, 'clause', array_to_string(s, ' ') from s where len(s) <= 3)
    select doc_id, chunk, chunk_type, text, {_TOKENS.format(_SPLIT.format('text'))} as est_tokens from out_"""
)
def semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences broken where neighbours are unlike, merged and split to size."""
    return C.semantic_chunks(documents(spark, sf_dir), MAX)


def _marked(pattern: str, column: str) -> str:
    """Rows (..., at, body, n, i) of a text cut where the pattern begins."""
    return rf"string_split(regexp_replace({column}, '{pattern}', chr(31) || '\0', 'g'), chr(31))"


_RE2 = lambda p: p.replace("(?imd)", "(?im)").replace("'", "''")
_HEADING, _ARTICLE, _SECTION, _DEFINITION = (_RE2(p) for p in (S.HEADING, S.ARTICLE, S.SECTION, S.DEFINITION))
_AT = "cast(coalesce(list_sum(list_transform(parts[1 : i - 1], lambda x: length(x))), 0) as int)"
_SQUEEZED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def _cut(source: str, pattern: str, column: str = "text") -> str:
    return f"select *, parts[i] as body, {_AT} as pos from (select *, unnest(range(1, len(parts) + 1)) as i, len(parts) as n from (select *, {_marked(pattern, column)} as parts from {source}))"


@named(
    rf"""with {DOCS}, t as (select doc_id, case when heading is not null then '1. ' || heading || chr(10) || text else text end as text from docs),
    p as (select doc_id, pos, body, i = n as final, regexp_extract(body, '{_HEADING}') as head from ({_cut('t', _HEADING)}) where trim(regexp_replace(body, '\s+', '', 'g')) <> ''),
    r as (select *, case when final then least(length(body), length(head) + 2500) else length(body) end as reach from p where head <> '' and starts_with(body, head)),
    b as (select *, regexp_replace(substr(body, 1, reach), '^\s+|\s+$', '', 'g') as b from r),
    k as (select *, case when length(b) > 2500 then regexp_replace(regexp_replace(substr(b, 1, 2500), ' [^ ]*$', ''), '^\s+|\s+$', '', 'g') else b end as k from b)
    select doc_id, {_SQUEEZED.format(f"regexp_extract(head, '{_HEADING}', 1)")} as title, k as text, pos as start, cast(pos + least(reach, length(k)) as int) as "end" from k where len(regexp_extract_all(k, '[\p{{L}}\p{{N}}_]+')) >= 25"""
)
def heading_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that headings open, from documents and the headings kept beside them."""
    d = documents(spark, sf_dir, "text", "heading")
    numbered = F.when(F.col("heading").isNotNull(), F.concat(F.lit("1. "), "heading", F.lit("\n"), "text")).otherwise(F.col("text"))
    return C.sections(d.select("doc_id", numbered.alias("text")))


# Contract texts with an opening, so that bodies begin somewhere.
_OPENED = "'CONTENTS' || chr(10) || 'ARTICLE 1' || chr(10) || 'Scope ........ 2' || chr(10) || case when contract_id is null then '' else 'The parties agree as follows:' || chr(10) end || 'ARTICLE 1' || chr(10) || 'Scope' || chr(10) || text"


@named(
    rf"""with {DOCS}, t as (select doc_id, {_OPENED} as text from docs),
    b as (select doc_id, text, regexp_extract(text, '(?is)^.*?(?:agree\s+as\s+follows)(.*)$', 1) as b1, regexp_matches(text, '(?i)agree\s+as\s+follows') as m1, regexp_extract(text, '(?is)^.*?(?:WITNESSETH)(.*)$', 1) as b2, regexp_matches(text, '(?i)WITNESSETH') as m2,
    regexp_extract(text, '(?is)^.*?(?:NOW,?\s+THEREFORE)(.*)$', 1) as b3, regexp_matches(text, '(?i)NOW,?\s+THEREFORE') as m3 from t),
    c as (select doc_id, text, m1 or m2 or m3 as m, case when m1 then b1 when m2 then b2 else b3 end as behind from b),
    d as (select doc_id, text, m, case when m then length(text) - length(behind) + case when regexp_matches(behind, '{_ARTICLE}') then length(({_marked(_ARTICLE, "behind")})[1]) else 0 end end as a from c),
    h as (select doc_id, min(pos) as pos from ({_cut('t', _ARTICLE)}) where regexp_extract(body, '{_ARTICLE}') <> '' and not regexp_matches(substr(text, pos + length(regexp_extract(body, '{_ARTICLE}')) + 1, 200), '\.{{5,}}') group by doc_id),
    e as (select d.doc_id, text, coalesce(a, pos, 0) as a from d left join h on h.doc_id = d.doc_id)
    select doc_id, cast(length(regexp_replace(substr(text, 1, a), '^\s+|\s+$', '', 'g')) as int) as front, cast(case when a > 0 then length(regexp_replace(substr(text, a + 1), '^\s+|\s+$', '', 'g')) else length(text) end as int) as body from e"""
)
def front_and_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of what stands before and in the body of each text under a table of contents."""
    d = documents(spark, sf_dir, "text", "contract_id")
    lead = F.when(F.col("contract_id").isNull(), "").otherwise("The parties agree as follows:\n")
    opened = F.concat(F.lit("CONTENTS\nARTICLE 1\nScope ........ 2\n"), lead, F.lit("ARTICLE 1\nScope\n"), "text")
    out = C.strip_contents(d.select("doc_id", opened.alias("text")))
    return out.select("doc_id", F.length("front").alias("front"), F.length("body").alias("body"))


def _head_sql(column: str, pattern: str) -> str:
    one, two = (f"nullif({_SQUEEZED.format(f'regexp_extract({column}, {chr(39)}{pattern}{chr(39)}, {i})')}, '')" for i in (1, 2))
    return f"trim(concat_ws(': ', {one}, {two}))"


# Contract texts under an article and a section heading.
_HEADED = "'ARTICLE 1' || chr(10) || 'Scope' || chr(10) || 'Section 1.1. Fees. ' || text || chr(10) || 'Section 1.2. Term. End.'"


@named(
    rf"""with {DOCS}, t as (select doc_id, {_HEADED} as text from docs), a as (select doc_id, pos as base, case when regexp_matches(body, '{_ARTICLE}') then {_head_sql('body', _ARTICLE)} when pos = 0 then 'PREAMBLE' end as article, body as text from ({_cut('t', _ARTICLE)}) where regexp_replace(body, '\s+', '', 'g') <> ''),
    s as (select doc_id, article, {_head_sql('body', _SECTION)} as section, base + pos as pos, trim(body) as text from ({_cut('a', _SECTION)}) where regexp_replace(body, '\s+', '', 'g') <> '')
    select doc_id, article, section, min(pos) as "at", cast(sum(length(text)) as bigint) as chars from s group by doc_id, article, section"""
)
def articles_and_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir)
    headed = F.concat(F.lit("ARTICLE 1\nScope\nSection 1.1. Fees. "), "text", F.lit("\nSection 1.2. Term. End."))
    return C.structure(d.select("doc_id", headed.alias("text"))).groupBy("doc_id", "article", "section").agg(F.min("at").alias("at"), F.sum(F.length("text")).alias("chars"))


@named(
    rf"""with {EVIDENCE}, {DOCS}, t as (select evidence_id as doc_id, '“' || clause_type || '” means ' || d.text || chr(10) || '"Other": ' || coalesce(ev.heading, '') as text from ev join docs d on cast(d.doc_id as varchar) = ev.doc_id where clause_type is not null)
    select doc_id as evidence_id, regexp_extract(body, '{_DEFINITION}', 1) as term, pos as "at", cast(length(regexp_replace(body, '^\s+|\s+$', '', 'g')) as int) as chars from ({_cut('t', _DEFINITION)}) where regexp_extract(body, '^{_DEFINITION[4:] if _DEFINITION.startswith("(?m)") else _DEFINITION}', 1) <> ''"""
)
def definition_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions written over passages of evidence, found again."""
    ev = evidence(spark, sf_dir, "clause_type", "doc_id", "heading").where("clause_type is not null")
    d = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    text = F.concat(F.lit("“"), "clause_type", F.lit("” means "), "text", F.lit('\n"Other": '), F.coalesce("heading", F.lit("")))
    out = C.definitions(ev.join(d, "doc_id").select(F.col("evidence_id").alias("doc_id"), text.alias("text")))
    return out.select(F.col("doc_id").alias("evidence_id"), "term", "at", F.length("text").alias("chars"))


_WORDS = r"list_distinct(list_filter(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' '), lambda w: w <> ''))"


@named(
    f"""with recursive {DOCS}, {bm25_sql()}, m as (select category, doc_id, max(score) as score from sc join queries using (query_id) group by category, doc_id),
    r as (select *, row_number() over (partition by category order by score desc, doc_id) as rk from m), top as (select category, doc_id, rk, {_WORDS} as w from r join docs using (doc_id) where rk <= 30),
    l as (select category, list(struct_pack(id := doc_id, w := w) order by rk) as items from top group by category),
    f(category, items, i, taken) as (select category, items, 1::bigint, items[1:0] from l union all select category, items, i + 1,
    case when len(taken) >= 3 or len(list_filter(taken, lambda p: len(p.w) > 0 and len(items[i].w) > 0 and len(list_intersect(p.w, items[i].w)) / len(list_distinct(list_concat(p.w, items[i].w))) > 0.5)) > 0 then taken
    else list_append(taken, items[i]) end from f where i <= len(items))
    select category, unnest(list_transform(taken, lambda t: t.id)) as doc_id from f where i = len(items) + 1"""
)
def diverse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three best documents of a category none of which is half alike to a better one."""
    q, d = read(spark, sf_dir, "queries"), documents(spark, sf_dir)
    best = R.bm25(q, d).join(q.select("query_id", "category"), "query_id").groupBy("category", "doc_id").agg(F.max("score").alias("score"))
    top = R.ranked(best, "category", "doc_id", 30).join(d, "doc_id")
    lists = top.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("rk", "doc_id", W.word_set(F.col("text")).alias("w")))).alias("l"))  # at most 30 a category
    return lists.select("category", F.explode(F.transform(S.diverse(F.col("l"), 3), lambda x: x["doc_id"])).alias("doc_id"))


# Orders stand for a log of runs: price the metric, status kept or not.
@named(
    """with r as (select o_orderkey as run, o_custkey as arm, o_orderdate as ts, round(o_totalprice, 2) as metric from orders),
    b as (select *, max(metric) over (partition by arm order by ts, run rows between unbounded preceding and 1 preceding) as best from r)
    select run, arm, metric, case when best is null or metric > best then 'kept' else 'discarded' end as status from b"""
)
def keep_best_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each arm in order: kept when better than every earlier one."""
    r = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run"), F.col("o_custkey").alias("arm"), F.col("o_orderdate").alias("at"), F.round("o_totalprice", 2).alias("metric"))
    best = F.max("metric").over(Window.partitionBy("arm").orderBy("at", "run").rowsBetween(Window.unboundedPreceding, -1))
    return r.select("run", "arm", "metric", F.when(best.isNull() | (F.col("metric") > best), "kept").otherwise("discarded").alias("status"))


@named(
    """with k as (select o_orderpriority as arm, o_orderstatus as status, round(max(o_totalprice), 2) as metric from orders group by all), b as (select max(metric) as base from k where arm like '1-%')
    select arm, status, metric, round(metric - base, 2) as delta, metric > base as better, case when metric > base then 'some support' when metric < base then 'no transfer' else 'not improved' end as verdict from k cross join b"""
)
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every arm against a baseline row, with a verdict."""
    k = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("arm"), F.col("o_orderstatus").alias("status")).agg(F.round(F.max("o_totalprice"), 2).alias("metric"))
    base = k.where(F.startswith("arm", F.lit("1-"))).agg(F.max("metric").alias("base"))
    d = F.col("metric") - F.col("base")
    verdict = F.when(d > 0, "some support").when(d < 0, "no transfer").otherwise("not improved")
    return k.crossJoin(F.broadcast(base)).select("arm", "status", "metric", F.round(d, 2).alias("delta"), (d > 0).alias("better"), verdict.alias("verdict"))


@named(
    """with p as (select vec_id, label, list_dot_product(list_transform(embedding, lambda x: cast(x as double)), list_transform(embedding, lambda x: cast(x as double))) as full_, list_sum(list_transform(embedding, lambda x: round(cast(x as double), 2) * round(cast(x as double), 2))) as small from embeddings)
    select label, round(max(abs(full_ - small)), 6) as max_diff, round(avg(abs(full_ - small) / greatest(abs(full_), 1e-9)), 6) as mean_rel_diff, count(*) as n from p group by label"""
)
def encoder_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of rounded vectors against full ones: largest and mean relative difference."""
    e = read(spark, sf_dir, "embeddings")
    small = F.transform("embedding", lambda x: F.round(x.cast("double"), 2))
    p = e.select("label", R.dot(F.col("embedding"), F.col("embedding")).alias("a"), R.dot(small, small).alias("b"))
    d = F.abs(F.col("a") - F.col("b"))
    return p.groupBy("label").agg(F.round(F.max(d), 6).alias("max_diff"), F.round(F.avg(d / F.greatest(F.abs("a"), F.lit(1e-9))), 6).alias("mean_rel_diff"), F.count("*").alias("n"))


@named(
    """with gates(gate) as (values ('graded_clauses'), ('qa_contracts'), ('merger_qa')), s as (select distinct source from training_record where source is not null)
    select source, gate, (source = 'graded_clauses' or source like 'qa_%') and gate <> 'merger_qa' as skipped from s cross join gates"""
)
def leakage_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates that a model trained on a source must not be judged by."""
    gates = spark.createDataFrame([("graded_clauses",), ("qa_contracts",), ("merger_qa",)], "gate string")
    s = read(spark, sf_dir, "training_record").where("source is not null").select("source").distinct()
    tainted = W.glob_match(F.col("source"), ["graded_clauses", "qa_*"]) & (F.col("gate") != "merger_qa")
    return s.crossJoin(gates).select("source", "gate", tainted.alias("skipped"))


@named(
    f"""with e as (select user_id, ts, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as before from events where user_id is not null and event_type is not null),
    r as (select user_id, sum(case when before is null or before <> event_type then 1 else 0 end) as runs, count(*) as events from e group by user_id) select user_id, cast(runs as bigint) as runs, events from r"""
)
def change_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equal values in order of time."""
    e = read(spark, sf_dir, "events").where("user_id is not null and event_type is not null")
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    e = e.withColumn("new", (before.isNull() | (before != F.col("event_type"))).cast("int"))
    return e.groupBy("user_id").agg(F.sum("new").alias("runs"), F.count("*").alias("events"))


@named(
    f"""with {EVIDENCE}, {DOCS} select coalesce(clause_type, 'none') as clause_type, coalesce(d.lang, 'none') as lang, count(*) as n, array_to_string(list_sort(list(distinct ev.query_id)), ',') as query_ids
    from ev join docs d on cast(d.doc_id as varchar) = ev.doc_id group by all"""
)
def grouped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per clause type and language with the set of their queries."""
    ev = evidence(spark, sf_dir, "clause_type", "doc_id", "query_id")
    d = documents(spark, sf_dir, "lang").select(F.col("doc_id").cast("string").alias("doc_id"), "lang")
    by = ev.join(d, "doc_id").groupBy(F.coalesce("clause_type", F.lit("none")).alias("clause_type"), F.coalesce("lang", F.lit("none")).alias("lang"))
    return by.agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("query_id")), ",").alias("query_ids"))  # queries are a small fixed set


@named(
    f"""with {JUDGED}, a as (select doc_id from judged where grade >= 3), b as (select doc_id from heading_evidence where doc_id is not null)
    select doc_id, 'both' as side from (select doc_id from a intersect select doc_id from b) union all select doc_id, 'judged' from (select doc_id from a except select doc_id from b)
    union all select doc_id, 'heading' from (select doc_id from b except select doc_id from a)"""
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = judged(spark, sf_dir).where("grade >= 3").select("doc_id")
    b = read(spark, sf_dir, "heading_evidence").where("doc_id is not null").select("doc_id")
    tag = lambda d, s: d.withColumn("side", F.lit(s))
    return tag(a.intersect(b), "both").union(tag(a.subtract(b), "judged")).union(tag(b.subtract(a), "heading"))


@named("select event_id, user_id, event_type from (select *, row_number() over (partition by user_id, event_type, cast(epoch(ts) as bigint) order by event_id) as r from events) where r = 1")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a bounded stream, one a user, type and second (the first id)."""
    from lexmill.streaming.dedup import first_per_key

    return first_per_key(spark, f"{sf_dir}/events.parquet")
