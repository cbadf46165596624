"""Joins, splits, negatives, balance and expansion on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import words as W
from lexmill.operators import mining as N
from lexmill.operators import ranking as R
from lexmill.plans.base import chunks, documents, evidence, judged, records
from lexmill.plans.ranking import _TOPICAL, bm25_sql
from lexmill.plans.registry import CHUNKS, DOCS, EVIDENCE, JUDGED, RECORDS, named, sql_list, tokens
from lexmill.plans.rules import HEADINGS, SUBTYPES
from lexmill.plans.text import _keys
from lexmill.tables import read


def _sha(*parts: str) -> str:
    return "sha1(concat_ws(':', '42', " + ", ".join(f"cast({p} as varchar)" for p in parts) + "))"


@named(f"with {DOCS}, {JUDGED} select q.query_id, d.doc_id, q.category, cast(length(d.text) as int) as chars, j.grade from judged j join queries q using (query_id) join docs d on cast(d.doc_id as varchar) = j.doc_id")
def qrels_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements whose query and document both exist."""
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), F.length("text").alias("chars"))
    out = judged(spark, sf_dir).join(read(spark, sf_dir, "queries").select("query_id", "category"), "query_id").join(docs, "doc_id")
    return out.select("query_id", F.col("doc_id").cast("long").alias("doc_id"), "category", "chars", "grade")


@named(
    f"""with {DOCS}, {JUDGED}, top as (select doc_id from docs) select q.query_id, t.doc_id, coalesce(j.grade, 0) as rel from queries q cross join top t
    left join judged j on j.query_id = q.query_id and j.doc_id = cast(t.doc_id as varchar)""",
    name="relevance_default",
)
def relevance_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grade of each query and document, 0 where nobody judged.

    Grades meet their document before the queries multiply it, so only documents move."""
    docs = documents(spark, sf_dir).select("doc_id", F.col("doc_id").cast("string").alias("key"))
    marks = judged(spark, sf_dir).where("query_id is not null").groupBy(F.col("doc_id").alias("key"))
    marks = marks.agg(F.map_from_entries(F.collect_list(F.struct("query_id", "grade"))).alias("grades"))
    grid = docs.join(marks, "key", "left").join(read(spark, sf_dir, "queries").select("query_id"), F.lit(True))
    return grid.select("query_id", "doc_id", F.coalesce(F.try_element_at("grades", F.col("query_id")), F.lit(0)).alias("rel"))


_PARTS = f"""keys as (select distinct contract_id from recs where contract_id is not null),
    ranked as (select contract_id, row_number() over (order by {_sha('contract_id')}, contract_id) as r, count(*) over () as n from keys),
    parts as (select contract_id, case when r <= greatest(1, floor(n * 0.1)) then 'dev' when r <= greatest(1, floor(n * 0.1)) * 2 then 'test' else 'train' end as part from ranked)"""


@named(f"with {RECORDS}, {_PARTS} select rec_id, part from recs join parts using (contract_id)")
def contract_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records split by contract: a tenth of contracts dev, a tenth test."""
    rows = records(spark, sf_dir, "contract_id").where("contract_id is not null")
    return rows.join(N.group_split(rows, "contract_id"), "contract_id").select("rec_id", "part")


@named(f"with {RECORDS}, {_PARTS}, held as (select contract_id from parts where part <> 'train') select rec_id from recs where contract_id is not null and contract_id not in (select contract_id from held)")
def heldout_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of no held-out contract (union of held-out keys, anti join)."""
    rows = records(spark, sf_dir, "contract_id").where("contract_id is not null")
    parts = N.group_split(rows, "contract_id")
    held = parts.where("part = 'dev'").select("contract_id").union(parts.where("part = 'test'").select("contract_id"))
    return rows.join(held, "contract_id", "left_anti").select("rec_id")


_FOLD = r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))"


@named(
    f"""with {DOCS}, d as (select doc_id, {_FOLD.format('text')} as t from docs), i as (select item_id, {_FOLD.format('positive')} as m from eval_items where positive is not null)
    select doc_id, item_id from d, i where t <> '' and m <> '' and (contains(t, m) or contains(m, t))"""
)
def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a protected text or are held by one, case and spacing apart."""
    items = read(spark, sf_dir, "eval_items").select("item_id", F.col("positive").alias("text"))
    return N.contains_join(documents(spark, sf_dir), items)


_CHAIN = " ".join(f"when regexp_matches(lower(clause_type), '{p}') then '{f}|{s}'" for f, s, p, _ in SUBTYPES)


@named(f"with {EVIDENCE}, r as (select evidence_id, case {_CHAIN} end as m from ev where clause_type is not null) select evidence_id, split_part(m, '|', 1) as family, split_part(m, '|', 2) as subtype from r where m is not null")
def pattern_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence routed to the first subtype whose pattern its label holds."""
    rows = evidence(spark, sf_dir, "clause_type").where("clause_type is not null")
    return N.first_match(rows, "clause_type", [r[:3] for r in SUBTYPES]).select("evidence_id", "family", "subtype")


_GUARDS = ", ".join(f"('{f}', '{s}', {repr(g) if g else 'null'})" for f, s, _, g in SUBTYPES)
_ROUTED = f"""routed as (select ev.evidence_id, split_part(m, '|', 1) as family, split_part(m, '|', 2) as subtype, d.text from (select *, case {_CHAIN} end as m from ev where clause_type is not null) ev
    join docs d on cast(d.doc_id as varchar) = ev.doc_id where m is not null), rules(family, subtype, guard) as (values {_GUARDS})"""


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence(spark, sf_dir, "clause_type", "doc_id").where("clause_type is not null")
    routed = N.first_match(rows, "clause_type", [r[:3] for r in SUBTYPES])
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return routed.join(docs, "doc_id").select("evidence_id", "family", "subtype", "text")


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f, s, g) for f, s, _, g in SUBTYPES], "family string, subtype string, guard string")


@named(
    f"""with {EVIDENCE}, {DOCS}, {_ROUTED}, sib as (select a.subtype, b.evidence_id from rules a join routed b on a.family = b.family and a.subtype <> b.subtype
    where a.guard is not null and not regexp_matches(lower(b.text), a.guard)) select subtype, count(*) as siblings, min(evidence_id) as first_sibling from sib group by subtype"""
)
def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of the same family and another subtype that the subtype's guard does not hit."""
    # Each passage is held against the guards of its family once; only (subtype, id) go on.
    hit = _unguarded(_routed(spark, sf_dir))
    return hit.groupBy(F.col("target").alias("subtype")).agg(F.count("*").alias("siblings"), F.min("evidence_id").alias("first_sibling"))


def _unguarded(routed: DataFrame) -> DataFrame:
    """(target, evidence_id): passages of another subtype of the target's family that its guard
    does not hit. The rules are configuration, a literal list of tests, so nothing is joined."""
    tests = [
        F.when((F.col("family") == f) & (F.col("subtype") != s_) & ~F.rlike(F.lower("text"), F.lit(g)), F.lit(s_))
        for f, s_, _, g in SUBTYPES if g
    ]
    return routed.select("evidence_id", F.explode(F.array_compact(F.array(*tests))).alias("target"))


@named(
    f"""with {CHUNKS}, c as (select chunk_id, doc_id, coalesce(text, '') as text from chunks)
    select chunk_id, string_agg(text, chr(10) || chr(10)) over (partition by doc_id order by chunk_id rows between 1 preceding and 1 following) as context from c where doc_id is not null"""
)
def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk with its neighbours, joined by empty lines."""
    w = Window.partitionBy("doc_id").orderBy("chunk_id").rowsBetween(-1, 1)
    c = chunks(spark, sf_dir).where("doc_id is not null").select("chunk_id", "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return c.select("chunk_id", F.array_join(F.collect_list("text").over(w), "\n\n").alias("context"))


@named(
    """with p as (select event_id, user_id, ts from events), s as (select user_id, min(ts) as ts0, event_type from events where event_type is not null group by user_id, event_type)
    select e.event_id, arg_max(s.event_type, struct_pack(a := s.ts0, b := s.event_type)) as page from p e join s on s.user_id = e.user_id and s.ts0 <= e.ts group by e.event_id"""
)
def page_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of lookup: the last of a user's marks that began at or before each event.

    Marks and events are merged into one ordered run per user, so nothing is multiplied."""
    e = read(spark, sf_dir, "events")
    marks = e.where("event_type is not null").groupBy("user_id", "event_type").agg(F.min("ts").alias("ts"))
    run = marks.select("user_id", "ts", F.lit(None).cast("long").alias("event_id"), "event_type", F.lit(0).alias("o")).unionByName(e.select("user_id", "ts", "event_id", F.lit(None).cast("string").alias("event_type"), F.lit(1).alias("o")))
    w = Window.partitionBy("user_id").orderBy("ts", "o", "event_type").rowsBetween(Window.unboundedPreceding, 0)
    return run.select("event_id", F.last("event_type", ignorenulls=True).over(w).alias("page"), "o").where("o = 1 and page is not null").select("event_id", "page")


@named(
    f"""with {JUDGED}, sheet as (select query_id, doc_id, case when grade >= 3 then 1 when grade = 2 then null else 0 end as label from judged)
    select query_id, sum(case when label = 1 then 1 else 0 end)::bigint as positives, sum(case when label is null then 1 else 0 end)::bigint as unlabeled, coalesce(array_to_string(list_sort(list(doc_id) filter (where label = 1)), ','), '') as docs from sheet group by query_id"""
)
def label_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filled judging sheet back to judgements; unlabelled rows are counted, not used."""
    sheet = judged(spark, sf_dir).select("query_id", "doc_id", F.when(F.col("grade") >= 3, 1).when(F.col("grade") == 2, None).otherwise(0).alias("label"))
    by = sheet.groupBy("query_id").agg(
        F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("positives"), F.sum(F.col("label").isNull().cast("int")).alias("unlabeled"), F.sort_array(F.collect_list(F.when(F.col("label") == 1, F.col("doc_id")))).alias("d")
    )
    return by.select("query_id", "positives", "unlabeled", F.array_join("d", ",").alias("docs"))


@named(
    f"""with {RECORDS}, p as (select category, list(text order by query_id) as texts from queries group by category), r as (select rec_id, category, texts from recs join queries on queries.text = recs.query join p using (category))
    select rec_id, texts[1 + cast('0x' || substr({_sha('rec_id')}, 1, 8) as bigint) % len(texts)] as paraphrase from r"""
)
def paraphrase_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record's query exchanged for one of its category's wordings, drawn by seed."""
    q = read(spark, sf_dir, "queries")
    lists = q.groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("query_id", "text"))), lambda x: x["text"]).alias("texts"))
    r = records(spark, sf_dir, "query").join(q.select(F.col("text").alias("query"), "category"), "query").join(lists, "category")
    h = F.conv(F.substring(N.draw("rec_id"), 1, 8), 16, 10).cast("long")
    return r.select("rec_id", F.element_at("texts", (F.pmod(h, F.size("texts").cast("long")) + 1).cast("int")).alias("paraphrase"))


_NEG = f"{DOCS}, {JUDGED}, {bm25_sql()}, pos as (select query_id, cast(doc_id as bigint) as doc_id from judged where grade >= 3)"


@named(
    f"""with {_NEG}, rq as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rk from sc),
    qk as (select query_id, {_keys('text')} as k from queries), dk as (select doc_id, {tokens('text')} as w from docs),
    kept as (select rq.query_id, rq.doc_id, rk from rq join qk using (query_id) join dk on dk.doc_id = rq.doc_id where rk <= 500 and not exists (select 1 from pos where pos.query_id = rq.query_id and pos.doc_id = rq.doc_id)
    and (case when len(k) > 0 then len(list_intersect(k, w)) / len(k) else 0.0 end) <= 0.75),
    f as (select query_id, doc_id, rk from (select *, row_number() over (partition by query_id order by rk) as n from kept) where n <= 5),
    need as (select q.query_id, 5 - count(f.doc_id) as need from queries q left join f using (query_id) group by q.query_id),
    line as (select doc_id, row_number() over (order by {_sha('doc_id')}, doc_id) - 1 as r0, count(*) over () as size from docs),
    pool as (select need.query_id, d.doc_id, need, row_number() over (partition by need.query_id order by ((r0 - cast('0x' || substr({_sha('need.query_id')}, 1, 8) as bigint)) % size + size) % size) as n from need cross join line d where need > 0
    and not exists (select 1 from pos where pos.query_id = need.query_id and pos.doc_id = d.doc_id) and not exists (select 1 from f where f.query_id = need.query_id and f.doc_id = d.doc_id))
    select query_id, doc_id, cast(rk as int) as rk, false as filled from f union all select query_id, doc_id, null, true from pool where n <= need"""
)
def bm25_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five hard negatives a query: high BM25, low keyword overlap, no positives; filled by seed."""
    q, d = read(spark, sf_dir, "queries"), documents(spark, sf_dir)
    pos = judged(spark, sf_dir).where("grade >= 3").select("query_id", F.col("doc_id").cast("long").alias("doc_id"))
    return N.hard_negatives(R.bm25(q, d), q, d, pos, 5)


@named(
    f"""with {_NEG}, rq as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rk from sc),
    kept as (select rq.query_id, rq.doc_id, rk from rq join queries q using (query_id) join docs d on d.doc_id = rq.doc_id where rk <= 100 and not contains(lower(d.text), replace(lower(q.category), '_', ' '))
    and not exists (select 1 from pos where pos.query_id = rq.query_id and pos.doc_id = rq.doc_id))
    select query_id, arg_min(doc_id, rk) as doc_id, cast(min(rk) as int) as rk from kept group by query_id"""
)
def phrase_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One negative a query that does not name the query's category."""
    q, d = read(spark, sf_dir, "queries"), documents(spark, sf_dir)
    pos = judged(spark, sf_dir).where("grade >= 3").select("query_id", F.col("doc_id").cast("long").alias("doc_id"))
    top = R.ranked(R.bm25(q, d), "query_id", "doc_id", 100).join(pos, ["query_id", "doc_id"], "left_anti")
    named_ = q.select("query_id", F.replace(F.lower("category"), F.lit("_"), F.lit(" ")).alias("phrase"))
    free = top.join(named_, "query_id").join(d, "doc_id").where(~F.contains(F.lower("text"), F.col("phrase")))
    return free.groupBy("query_id").agg(F.min_by("doc_id", "rk").alias("doc_id"), F.min("rk").alias("rk"))


@named(
    f"""with {JUDGED}, f as (select *, max(case when grade >= 4 then 1 else 0 end) over (partition by query_id) as strong from judged),
    p as (select query_id, doc_id, grade from f where (strong = 1 and grade >= 4) or (strong = 0 and grade = 3)),
    n as (select query_id, list(doc_id order by grade desc, doc_id)[1:3] as negatives from judged where grade <= 2 group by query_id)
    select p.query_id, p.doc_id, p.grade, array_to_string(negatives, ',') as negatives from p join n using (query_id)"""
)
def graded_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strong positives (grade 3 where there are none) with the three best-graded negatives."""
    j = judged(spark, sf_dir)
    f = j.withColumn("strong", F.max((F.col("grade") >= 4).cast("int")).over(Window.partitionBy("query_id")))
    p = f.where("(strong = 1 and grade >= 4) or (strong = 0 and grade = 3)").select("query_id", "doc_id", "grade")
    n = j.where("grade <= 2").withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "doc_id"))).where("r <= 3")
    n = n.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("r", "doc_id"))).alias("l"))
    return p.join(n, "query_id").select("query_id", "doc_id", "grade", F.array_join(F.transform("l", lambda x: x["doc_id"]), ",").alias("negatives"))


@named(
    f"""with {RECORDS}, r as (select rec_id, source, row_number() over (partition by source order by {_sha('rec_id')}, rec_id) as r, count(*) over (partition by source) as n from recs where source is not null),
    x as (select *, (n > 400) as cut, (n <= 400 and n < 300) as grow from r), u as (select *, unnest(range(0, case when grow then cast(ceil(300 / n) as bigint) else 1 end)) as copy from x)
    select rec_id, source, cast(copy as int) as copy from u where case when cut then r <= 400 when grow then copy * n + r <= 300 else true end"""
)
def balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources cut to 400 records or repeated up to 300."""
    rows = records(spark, sf_dir, "source").where("source is not null")
    return N.balanced(rows, "source", "rec_id", 400, 300).select("rec_id", "source", "copy")


@named(
    f"""with {RECORDS}, r as (select rec_id, source, row_number() over (partition by source order by {_sha('rec_id')}, rec_id) as r, count(*) over (partition by source) as n from recs where source is not null)
    select rec_id, source, case when r <= least(30, n // 5) then 'eval' else 'train' end as part from r where n >= 30 and r <= least(30, n // 5) + 300"""
)
def cap_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "source").where("source is not null")
    return N.holdout_then_cap(rows, "source", "rec_id", cap=300).select("rec_id", "source", "part")


@named(
    f"""with {RECORDS}, r as (select rec_id, query, row_number() over (partition by query order by {_sha('rec_id')}, rec_id) as round from recs where query is not null)
    select rec_id, cast(round as int) as round from r order by round, {_sha('query')}, query limit 500"""
)
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 records, one of each query a round."""
    return N.round_robin(records(spark, sf_dir, "query").where("query is not null"), "query", "rec_id", 500).select("rec_id", "round")


_TRIPLES = f"""{RECORDS}, u as (select rec_id, query, positive, source, positive_grade, unnest(negatives) as negative from recs where query is not null and positive is not null),
    tri as (select * from u where negative <> '' and negative <> positive)"""


@named(f"with {_TRIPLES} select rec_id, query, positive, negative, source, positive_grade from tri")
def triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "query", "positive", "negatives", "source", "positive_grade").where("query is not null and positive is not null")
    return N.triplets(rows)


@named(
    f"""with {_TRIPLES} select source, kind, count(*) as n from (select source, 'base' as kind from tri union all select source, 'anchor' from tri, range(3) where source like 'graded%') group by source, kind"""
)
def anchor_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triplets and three more copies of those from one family of sources, counted."""
    base = triplets(spark, sf_dir).select("source")
    anchor = N.repeated(base.where(F.startswith("source", F.lit("graded"))), 3).drop("repeat")
    both = base.withColumn("kind", F.lit("base")).unionByName(anchor.withColumn("kind", F.lit("anchor")))
    return both.groupBy("source", "kind").agg(F.count("*").alias("n"))


@named(
    f"""with {_NEG}, rq as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rk from sc where not exists (select 1 from pos where pos.query_id = sc.query_id and pos.doc_id = sc.doc_id)),
    top as (select query_id, list(doc_id order by rk) as negs from rq where rk <= 4 group by query_id),
    cap as (select query_id, doc_id from (select *, row_number() over (partition by query_id order by {_sha('doc_id')}, doc_id) as n from pos) where n <= 3)
    select query_id, cap.doc_id as positive, array_to_string(list_concat([cap.doc_id], negs), ',') as document_ids from cap join top using (query_id)"""
)
def kd_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for a teacher to score: a positive (three a query) and the four best negatives."""
    q, d = read(spark, sf_dir, "queries"), documents(spark, sf_dir)
    pos = judged(spark, sf_dir).where("grade >= 3").select("query_id", F.col("doc_id").cast("long").alias("doc_id"))
    top = R.ranked(R.bm25(q, d).join(pos, ["query_id", "doc_id"], "left_anti"), "query_id", "doc_id", 4)
    negs = top.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rk", "doc_id"))), lambda x: x["doc_id"]).alias("negs"))
    kept = N.capped(pos, "query_id", "doc_id", 3)
    ids = F.concat(F.array("doc_id"), F.col("negs"))
    return kept.join(negs, "query_id").select("query_id", F.col("doc_id").alias("positive"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("document_ids"))


_KD = f"""{_NEG}, rq as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rk from sc where not exists (select 1 from pos where pos.query_id = sc.query_id and pos.doc_id = sc.doc_id)),
    top as (select query_id, list(doc_id order by rk) as negs from rq where rk <= 4 group by query_id),
    cap as (select query_id, doc_id from (select *, row_number() over (partition by query_id order by {_sha('doc_id')}, doc_id) as n from pos) where n <= 3),
    kd as (select query_id, list_concat([cap.doc_id], negs) as ids from cap join top using (query_id))"""


def _kd_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kd_rows(spark, sf_dir)
    return rows.select("query_id", F.transform(F.split("document_ids", ","), lambda x: x.cast("long")).alias("ids"))


@named(f"with {_KD}, x as (select query_id, ids[1] as positive, unnest(ids[2:3]) as negative from kd) select x.query_id, positive, negative, p.text as positive_text, n.text as negative_text from x join docs p on p.doc_id = positive join docs n on n.doc_id = negative")
def contrastive_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of ids to triplets: the first is the positive, the next two negatives; texts are
    looked up in the documents table."""
    x = _kd_arrays(spark, sf_dir).select("query_id", F.element_at("ids", 1).alias("positive"), F.explode(F.slice("ids", 2, 2)).alias("negative"))
    d = documents(spark, sf_dir)
    side = lambda n: d.select(F.col("doc_id").alias(n), F.col("text").alias(f"{n}_text"))
    return x.join(side("positive"), "positive").join(side("negative"), "negative").select("query_id", "positive", "negative", "positive_text", "negative_text")


@named(
    f"""with {_KD}, x as (select query_id, ids[1] as positive, unnest(ids) as doc_id, unnest(range(1, len(ids) + 1)) as place from kd)
    select query_id, positive, array_to_string(list(coalesce(sc.score, 0.0) order by place), ',') as scores from x left join sc using (query_id, doc_id) group by query_id, positive"""
)
def ordered_regroup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat scores of (query, document) pairs put back into arrays in the order of the ids."""
    x = _kd_arrays(spark, sf_dir).select("query_id", F.element_at("ids", 1).alias("positive"), F.posexplode("ids").alias("place", "doc_id"))
    scored = R.bm25(read(spark, sf_dir, "queries"), documents(spark, sf_dir))
    flat = x.join(scored, ["query_id", "doc_id"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    back = flat.groupBy("query_id", "positive").agg(F.array_sort(F.collect_list(F.struct("place", "score"))).alias("l"))  # five a row
    return back.select("query_id", "positive", F.array_join(F.transform("l", lambda p: p["score"].cast("string")), ",").alias("scores"))


@named(
    f"""with {RECORDS}, t as (select rec_id, source, {_FOLD.format('positive')} as t, coalesce(positive_grade, 0) >= 3 as yes from recs where positive is not null and source is not null),
    once as (select * from (select *, row_number() over (partition by source, t order by rec_id) as r from t) where r = 1),
    capped as (select *, row_number() over (partition by source, yes order by {_sha('rec_id')}, rec_id) as c from once)
    select source, 'nli-' || substr(sha1(source || chr(10) || t), 1, 16) as passage_id, yes as positive from capped where c <= 14"""
)
def yes_no_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yes and no passages of each task, deduplicated within the task, 14 of each."""
    t = records(spark, sf_dir, "source", "positive", "positive_grade").where("positive is not null and source is not null")
    t = t.select("rec_id", "source", N.folded(F.col("positive")).alias("t"), (F.coalesce("positive_grade", F.lit(0)) >= 3).alias("yes"))
    once = t.withColumn("r", F.row_number().over(Window.partitionBy("source", "t").orderBy("rec_id"))).where("r = 1")
    c = once.withColumn("c", F.row_number().over(Window.partitionBy("source", "yes").orderBy(N.draw("rec_id"), "rec_id"))).where("c <= 14")
    return c.select("source", W.stable_id("nli", F.concat("source", F.lit("\n"), "t")).alias("passage_id"), F.col("yes").alias("positive"))


_HEADS = ", ".join(f"('{c}', '{'|'.join(p)}')" for c, p in HEADINGS.items())
_TITLE = r"trim(trim(regexp_replace(lower(heading), '\s+', ' ', 'g')), '.:;- ')"


@named(
    f"""with {EVIDENCE}, heads(clause_type, rx) as (values {_HEADS}), h as (select evidence_id, {_TITLE} as title from ev where heading is not null)
    select evidence_id, heads.clause_type from h, heads where len(string_split(title, ' ')) <= 9 and regexp_matches(title, '\\b(?:' || rx || ')\\b')"""
)
def heading_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause types whose heading patterns a section title holds (configuration table)."""
    heads = spark.createDataFrame([(c, "\\b(?:" + "|".join(p) + ")\\b") for c, p in HEADINGS.items()], "clause_type string, rx string")
    t = F.btrim(W.squeeze(F.lower("heading")), F.lit(".:;- "))
    h = evidence(spark, sf_dir, "heading").where("heading is not null").select("evidence_id", t.alias("title")).where(F.size(F.split("title", " ")) <= 9)
    return h.join(heads, F.regexp_like("title", F.col("rx"))).select("evidence_id", "clause_type")


@named(
    f"""with {EVIDENCE}, {DOCS}, {_ROUTED}, 
    pool as (select r.subtype, s.evidence_id as negative, row_number() over (partition by r.subtype order by {_sha('s.evidence_id')}, s.evidence_id) - 1 as r0, count(*) over (partition by r.subtype) as size
    from rules r join routed s on s.family = r.family and s.subtype <> r.subtype where r.guard is not null and not regexp_matches(lower(s.text), r.guard)),
    sib as (select p.evidence_id, negative, 1 + ((r0 - cast('0x' || substr({_sha('p.evidence_id')}, 1, 8) as bigint)) % size + size) % size as n from routed p join pool using (subtype))
    select evidence_id, negative from sib where n <= 4"""
)
def depth_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to four sibling negatives a positive, drawn by seed."""
    routed = _routed(spark, sf_dir)
    pool = _unguarded(routed).select(F.col("target").alias("subtype"), F.col("evidence_id").alias("negative"))
    line = N.drawn_rank(pool, ["subtype"], N.draw("negative"), "negative").select("subtype", "negative", "_r", F.col("_n").alias("size"))
    sizes = line.groupBy("subtype").agg(F.max("size").alias("size"))
    turn = F.conv(F.substring(N.draw("evidence_id"), 1, 8), 16, 10).cast("long")
    places = F.sequence(F.lit(0).cast("long"), F.least(F.lit(4), F.col("size")) - 1)
    asked = routed.select("evidence_id", "subtype").join(sizes, "subtype").select("evidence_id", "subtype", F.explode(F.transform(places, lambda i: F.pmod(turn + i, F.col("size")) + 1)).alias("_r"))
    return asked.join(line, ["subtype", "_r"]).select("evidence_id", "negative")


@named(
    f"""with {_NEG}, rq as (select *, row_number() over (partition by query_id order by score desc, doc_id) as rk from sc), free as (select rq.*, row_number() over (partition by query_id order by rk) as place from rq
    where rk <= 250 and not exists (select 1 from pos where pos.query_id = rq.query_id and pos.doc_id = rq.doc_id)),
    s as (select *, row_number() over (partition by query_id order by {_sha('query_id', 'doc_id')}, doc_id) as n from free where place <= 40) select query_id, doc_id, cast(rk as int) as rk from s where n <= 3"""
)
def top_slice_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives a query drawn from the first forty free candidates of the top 250."""
    q, d = read(spark, sf_dir, "queries"), documents(spark, sf_dir)
    pos = judged(spark, sf_dir).where("grade >= 3").select("query_id", F.col("doc_id").cast("long").alias("doc_id"))
    free = R.ranked(R.bm25(q, d), "query_id", "doc_id", 250).join(pos, ["query_id", "doc_id"], "left_anti")
    free = free.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rk"))).where("place <= 40")
    s = free.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(N.draw("query_id", "doc_id"), "doc_id")))
    return s.where("n <= 3").select("query_id", "doc_id", "rk")


@named(
    f"""with {JUDGED}, active as (select query_id from judged where grade >= 3 group by query_id having count(*) >= 2)
    select j.query_id, count(*) as judgements, count(distinct j.doc_id) as docs from judged j join active using (query_id) group by j.query_id"""
)
def active_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with at least two positives, and what an evaluation file of theirs holds."""
    j = judged(spark, sf_dir)
    active = j.where("grade >= 3").groupBy("query_id").agg(F.count("*").alias("n")).where("n >= 2").select("query_id")
    return j.join(active, "query_id", "left_semi").groupBy("query_id").agg(F.count("*").alias("judgements"), F.countDistinct("doc_id").alias("docs"))


@named(
    f"""with {RECORDS}, p as (select distinct query, positive from recs where query is not null and positive is not null)
    select 'q-' || substr(sha1(query), 1, 16) as query_id, 'd-' || substr(sha1(positive), 1, 16) as doc_id, 1 as grade from p"""
)
def eval_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements of an evaluation file made from records, under content ids."""
    p = records(spark, sf_dir, "query", "positive").where("query is not null and positive is not null").select("query", "positive").distinct()
    return p.select(W.stable_id("q", F.col("query")).alias("query_id"), W.stable_id("d", F.col("positive")).alias("doc_id"), F.lit(1).alias("grade"))


@named(
    f"""with {RECORDS} select source, split, count(*) as records, sum(len(coalesce(negatives, [])))::bigint as negatives, count(distinct query) as queries from recs group by source, split"""
)
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a data set by source and split."""
    r = records(spark, sf_dir, "source", "split", "query", "negatives")
    return r.groupBy("source", "split").agg(F.count("*").alias("records"), F.sum(F.coalesce(F.size("negatives"), F.lit(0)).cast("long")).alias("negatives"), F.countDistinct("query").alias("queries"))
