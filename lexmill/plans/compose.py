"""Compositions: training records from questions, labels and subtypes, clause extraction, pools
of contracts, generated pairs, shuffles and row splits, report tables, written and read data."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill.functions import segments as S
from lexmill.functions import words as W
from lexmill.operators import mining as N
from lexmill.operators import ranking as R
from lexmill.plans.base import chunks, documents, evidence, judged, records
from lexmill.plans.mining import _CHAIN, _PARTS, _sha, _unguarded
from lexmill.plans.ranking import _MAXSIM, _RK, _maxsim, bm25_sql
from lexmill.plans.registry import CHUNKS, DOCS, EVIDENCE, JUDGED, RECORDS, named, tokens
from lexmill.plans.rules import SUBTYPES
from lexmill.plans.text import SQ
from lexmill.session import cut, table_dir
from lexmill.sources import files
from lexmill.tables import read


@named(f"with {RECORDS} select rec_id, row_number() over (order by {_sha('rec_id')}, rec_id) as place from recs")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its place in a shuffle by seed."""
    return N.drawn_rank(records(spark, sf_dir, "source"), [], N.draw("rec_id"), "rec_id").select("rec_id", F.col("_r").alias("place"))


@named(
    f"""with {RECORDS}, r as (select rec_id, row_number() over (order by {_sha('rec_id')}, rec_id) as r, count(*) over () as n from recs)
    select rec_id, case when r <= n * 0.05 then 'test' else 'train' end as part, case when r <= least(128, n // 20) then 'eval' else 'fit' end as capped from r"""
)
def row_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records split by row: a twentieth for testing, and a held-out part of at most 128."""
    r = N.drawn_rank(records(spark, sf_dir, "source"), [], N.draw("rec_id"), "rec_id")
    capped = F.col("_r") <= F.least(F.lit(128), F.floor(F.col("_n") / 20))
    return r.select("rec_id", F.when(F.col("_r") <= F.col("_n") * 0.05, "test").otherwise("train").alias("part"), F.when(capped, "eval").otherwise("fit").alias("capped"))


@named(f"with {RECORDS}, n as (select source, count(*) as n from recs where source is not null group by source) select count(*) as categories, min(n) as fewest, max(n) as most, sum(n)::bigint as rows from n")
def category_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest and largest number of records a category has."""
    n = records(spark, sf_dir, "source").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("categories"), F.min("n").alias("fewest"), F.max("n").alias("most"), F.sum("n").alias("rows"))


@named(
    f"""with {RECORDS}, n as (select source, count(*) as n from recs where source is not null group by source)
    select source, n, cast(row_number() over (order by n, source) as int) as by_count, cast(row_number() over (order by source) as int) as by_name from n"""
)
def ordered_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report table with its two orders: by value and by name (a row a source)."""
    n = records(spark, sf_dir, "source").where("source is not null").groupBy("source").agg(F.count("*").alias("n"))
    place = lambda *by: F.row_number().over(Window.orderBy(*by)).cast("int")
    return n.select("source", "n", place("n", "source").alias("by_count"), place("source").alias("by_name"))


@named(
    f"""with {RECORDS}, s as (select distinct source from recs where source is not null)
    select coalesce(t.source, s.source) as source, target_share, case when s.source is null then 'no records' when t.source is null then 'no target' else 'both' end as found
    from (select source, target_share from mix_targets) t full join s on s.source = t.source"""
)
def lookup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets looked up among the sources there are, and what is missing on either side."""
    s = records(spark, sf_dir, "source").where("source is not null").select(F.col("source").alias("own")).distinct()
    t = read(spark, sf_dir, "mix_targets").select("source", "target_share")
    found = F.when(F.col("own").isNull(), "no records").when(F.col("source").isNull(), "no target").otherwise("both")
    return t.join(s, F.col("source") == F.col("own"), "full").select(F.coalesce("source", "own").alias("source"), "target_share", found.alias("found"))


def skipped(ids: Column, skip: Column) -> Column:
    """Token ids without those of a skip list."""
    return F.filter(ids, lambda x: ~F.array_contains(skip, x))


def truncated(ids: Column, limit: int) -> Column:
    """The first `limit` ids, the last of them the last of all (a closing special token)."""
    return F.when(F.size(ids) > limit, F.concat(F.slice(ids, 1, limit - 1), F.slice(ids, -1, 1))).otherwise(ids)


@named(
    f"""with {DOCS}, t as (select doc_id, list_filter({tokens('text')}, lambda w: not list_contains(['the', 'of', 'and', 'to'], w)) as t from docs)
    select doc_id, cast(len(t) as int) as n, array_to_string(case when len(t) > 32 then list_concat(t[1:31], t[-1:]) else t end, ' ') as kept from t"""
)
def token_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens without those of a skip list, cut to 32 with the last one kept."""
    d = documents(spark, sf_dir).select("doc_id", skipped(W.tokenize(F.col("text")), F.array(*[F.lit(x) for x in ("the", "of", "and", "to")])).alias("t"))
    return d.select("doc_id", F.size("t").alias("n"), F.array_join(truncated(F.col("t"), 32), " ").alias("kept"))


@named(
    f"""with {_MAXSIM}, good as (select distinct label as query_id, vec_id // 10 as doc_id from embeddings), free as (select sc.* from sc where not exists (select 1 from good g where g.query_id = sc.query_id and g.doc_id = sc.doc_id)),
    r as (select *, {_RK} from free) select query_id, doc_id, score from r where rk = 1"""
)
def maxsim_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best document of each multi-vector query among those that hold nothing of its label."""
    good = read(spark, sf_dir, "embeddings").select(F.col("label").alias("query_id"), F.expr("vec_id div 10").alias("doc_id")).distinct()
    return R.ranked(_maxsim(spark, sf_dir).join(good, ["query_id", "doc_id"], "left_anti"), "query_id", "doc_id", 1).drop("rk")


_TOP = "row_number() over (partition by query_id order by score desc, doc_id)"
_POS = "pos as (select query_id, cast(doc_id as bigint) as doc_id from judged where grade >= 3)"


@named(
    f"""with {RECORDS}, {_PARTS}, {DOCS}, {JUDGED}, {bm25_sql()}, {_POS}, free as (select sc.* from sc where not exists (select 1 from pos where pos.query_id = sc.query_id and pos.doc_id = sc.doc_id)),
    neg as (select query_id, list(doc_id order by score desc, doc_id) as negatives from (select *, {_TOP} as rk from free) where rk <= 2 group by query_id),
    qa as (select q.query_id, q.text, pos.doc_id, d.contract_id, d.text as context from pos join queries q using (query_id) join docs d on d.doc_id = pos.doc_id where d.contract_id is not null)
    select query_id, doc_id, coalesce(part, 'train') as part, trim(substr(context, 1, 512), ' ') as positive, array_to_string(negatives, ',') as negatives from qa join neg using (query_id) left join parts using (contract_id)"""
)
def qa_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with an answering passage as training records: window of the passage, two hard
    negatives a question, and the part that the passage's contract is in."""
    q, d = read(spark, sf_dir, "queries"), documents(spark, sf_dir, "text", "contract_id")
    pos = judged(spark, sf_dir).where("grade >= 3").select("query_id", F.col("doc_id").cast("long").alias("doc_id"))
    top = R.ranked(R.bm25(q, d).join(pos, ["query_id", "doc_id"], "left_anti"), "query_id", "doc_id", 2)
    neg = top.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rk", "doc_id"))).alias("l"))  # two a query
    keys = records(spark, sf_dir, "contract_id").where("contract_id is not null")
    qa = pos.join(q.select("query_id"), "query_id").join(d.where("contract_id is not null"), "doc_id").join(neg, "query_id").join(N.group_split(keys, "contract_id"), "contract_id", "left")
    window = S.window(F.col("text"), F.lit(0), F.lit(0), 512)
    return qa.select("query_id", "doc_id", F.coalesce("part", F.lit("train")).alias("part"), window.alias("positive"), F.array_join(F.transform("l", lambda x: x["doc_id"].cast("string")), ",").alias("negatives"))


_LABELLED = f"lab as (select ev.evidence_id, lower(trim(clause_type)) as label, d.doc_id, d.text from ev join docs d on cast(d.doc_id as varchar) = ev.doc_id where clause_type is not null)"


@named(
    f"""with {EVIDENCE}, {DOCS}, {_LABELLED}, lq as (select distinct label as query_id, 'Find provisions related to "' || label || '".' as text from lab),
    {bm25_sql(queries='select query_id, text from lq')}, own as (select distinct label, doc_id from lab), free as (select sc.* from sc where not exists (select 1 from own where own.label = sc.query_id and own.doc_id = sc.doc_id)),
    neg as (select query_id, list(doc_id order by score desc, doc_id) as negatives from (select *, {_TOP} as rk from free) where rk <= 3 group by query_id)
    select own.label, own.doc_id as positive, array_to_string(negatives, ',') as negatives from own join neg on neg.query_id = own.label"""
)
def label_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query a label; every passage of the label with the three best passages of others."""
    d = documents(spark, sf_dir)
    key = d.select(F.col("doc_id").cast("string").alias("key"), "doc_id")
    own = evidence(spark, sf_dir, "clause_type", "doc_id").where("clause_type is not null").select(F.lower(F.trim("clause_type")).alias("label"), F.col("doc_id").alias("key"))
    own = own.join(key, "key").select("label", "doc_id").distinct()
    q = own.select(F.col("label").alias("query_id"), W.template_query(F.col("label")).alias("text")).distinct()
    free = R.bm25(q, d).join(own.select(F.col("label").alias("query_id"), "doc_id"), ["query_id", "doc_id"], "left_anti")
    neg = R.ranked(free, "query_id", "doc_id", 3).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rk", "doc_id"))).alias("l"))
    return own.join(neg, F.col("label") == F.col("query_id")).select("label", F.col("doc_id").alias("positive"), F.array_join(F.transform("l", lambda x: x["doc_id"].cast("string")), ",").alias("negatives"))


_GUARD_OF = " ".join(f"when '{s}' then {repr(g) if g else 'null'}" for _, s, _, g in SUBTYPES)
_MINED = f"""mined as (select ev.evidence_id, split_part(m, '|', 1) as family, split_part(m, '|', 2) as subtype, {SQ.format('d.text')} as text from (select *, case {_CHAIN} end as m from ev where clause_type is not null) ev
    join docs d on cast(d.doc_id as varchar) = ev.doc_id where m is not null), band as (select *, case subtype {_GUARD_OF} end as guard from mined where case when text = '' then 0 else len(string_split(text, ' ')) end between 10 and 320)"""


@named(f"with {EVIDENCE}, {DOCS}, {_MINED} select family, subtype, text, min(evidence_id) as evidence_id, count(*) as copies from band where guard is null or regexp_matches(lower(text), guard) group by family, subtype, text")
def mined_subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages routed to a subtype, within a word band, that the subtype's guard confirms; a
    text once a subtype."""
    rows = evidence(spark, sf_dir, "clause_type", "doc_id").where("clause_type is not null")
    routed = N.first_match(rows, "clause_type", [r[:3] for r in SUBTYPES])
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), W.squeeze(F.col("text")).alias("text"))
    band = routed.join(docs, "doc_id").where(W.word_count(F.col("text")).between(10, 320))
    confirmed = F.lit(True)
    for _, s, _, g in SUBTYPES:
        if g:
            confirmed = F.when(F.col("subtype") == s, F.rlike(F.lower("text"), F.lit(g))).otherwise(confirmed)
    return band.where(confirmed).groupBy("family", "subtype", "text").agg(F.min("evidence_id").alias("evidence_id"), F.count("*").alias("copies"))


@named(
    f"""with {EVIDENCE}, {DOCS}, {_MINED}, q as (select cast(evidence_id as varchar) as query_id, subtype, 'Find provisions related to "' || subtype || '". ' || substr(text, 1, 200) as text from band where guard is not null),
    pool as (select family, subtype, text, min(evidence_id) as doc_id from band group by family, subtype, text), {bm25_sql(queries='select query_id, text from q', docs='select doc_id, text from pool')},
    cand as (select sc.query_id, sc.doc_id, sc.score from sc join q using (query_id) join pool p on p.doc_id = sc.doc_id where p.subtype <> q.subtype and not regexp_matches(lower(p.text), case q.subtype {_GUARD_OF} end))
    select cast(query_id as bigint) as evidence_id, doc_id as negative, cast(rk as int) as rk from (select *, {_TOP} as rk from cand) where rk <= 2"""
)
def depth_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked leg of depth records: two passages of other subtypes nearest to the query and
    the beginning of the positive that the subtype's guard does not hit."""
    rows = evidence(spark, sf_dir, "clause_type", "doc_id").where("clause_type is not null")
    routed = N.first_match(rows, "clause_type", [r[:3] for r in SUBTYPES])
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    # Generated, so that Spark squeezes a text once, and only those that are routed.
    band = routed.join(docs, "doc_id").select("evidence_id", "family", "subtype", F.explode(F.array(W.squeeze(F.col("text")))).alias("text"))
    band = cut(band.where(F.size(F.split("text", " ")).between(10, 320)), "band")  # read three times below
    guarded = [(s, g) for _, s, _, g in SUBTYPES if g]  # a query's kind is its subtype's place here
    kind = F.array_position(F.array(*[F.lit(s) for s, _ in guarded]), F.col("subtype")).cast("int") - 1
    asks = band.select("evidence_id", kind.alias("kind"), F.concat(W.template_query(F.col("subtype")), F.lit(" "), F.substring("text", 1, 200)).alias("text")).where("kind >= 0")
    same = asks.groupBy("kind", "text").agg(F.min("evidence_id").alias("query_id"))  # each text is asked once
    pool = band.groupBy("family", "subtype", "text").agg(F.min("evidence_id").alias("doc_id"))
    free = [F.when((F.col("subtype") != s) & ~F.rlike(F.lower("text"), F.lit(g)), 1 << i).otherwise(0) for i, (s, g) in enumerate(guarded)]
    best = R.bm25_best(same, pool.select("doc_id", "text", sum(free[1:], free[0]).cast("long").alias("open")), 2)
    return asks.join(same, ["kind", "text"]).join(best, "query_id").select("evidence_id", F.col("doc_id").alias("negative"), "rk")


@named(
    f"""with {RECORDS}, x as (select rec_id, query, positive from recs where query is not null and positive is not null and source like 'graded%'), seen as (select distinct positive from recs where positive is not null and (source is null or source not like 'graded%')),
    fresh as (select * from x where positive not in (select positive from seen)) select rec_id, cast(unnest(range(1, 3)) as int) as repeat, query, positive from fresh"""
)
def extra_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of an extra file whose positives the others lack, each twice."""
    r = records(spark, sf_dir, "source", "query", "positive").where("positive is not null")
    extra = F.coalesce(F.startswith("source", F.lit("graded")), F.lit(False))
    seen = r.where(~extra).select("positive").distinct()
    fresh = r.where(extra & F.col("query").isNotNull()).join(seen, "positive", "left_anti")
    return N.repeated(fresh, 2).select("rec_id", "repeat", "query", "positive")


_VARIANTS = ("What does the contract say about {0}?", "Which clause governs {0}?", "Find provisions related to \"{0}\".")


def variants(category: Column, known: dict[str, list[str]] | None = None) -> Column:
    """Query texts for a clause type: its own where there are any, else the templates."""
    name = F.replace(F.lower(F.trim(category)), F.lit("_"), F.lit(" "))
    made = F.array(*[F.concat(F.lit(t.split("{0}")[0]), name, F.lit(t.split("{0}")[1])) for t in _VARIANTS])
    if not known:
        return made
    table = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    return F.coalesce(F.try_element_at(table, name), made)


_VARIANT_SQL = ", ".join("'" + t.replace("{0}", "' || replace(lower(trim(category)), '_', ' ') || '") + "'" for t in _VARIANTS)


@named(f"select category, cast(i as int) as i, v[i + 1] as text from (select category, [{_VARIANT_SQL}] as v, unnest(range(0, 3)) as i from (select distinct category from queries))")
def query_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three wordings of every category."""
    c = read(spark, sf_dir, "queries").select("category").distinct()
    return c.select("category", F.posexplode(variants(F.col("category"))).alias("i", "text"))


@named(
    f"""with {CHUNKS}, v as (select category || '#' || i as query_id, category, v[i + 1] as text from (select category, [{_VARIANT_SQL}] as v, unnest(range(0, 3)) as i from (select distinct category from queries))),
    cd as (select chunk_id as doc_id, text from chunks where text is not null), {bm25_sql(queries='select query_id, text from v', docs='select doc_id, text from cd')},
    m as (select category, doc_id, max(score) as score from sc join v using (query_id) group by category, doc_id), top as (select *, row_number() over (partition by category order by score desc, doc_id) as rk from m),
    ctx as (select chunk_id, string_agg(coalesce(text, ''), chr(10) || chr(10)) over (partition by doc_id order by chunk_id rows between 1 preceding and 1 following) as context from chunks where doc_id is not null)
    select category, top.doc_id as chunk_id, score, context from top join ctx on ctx.chunk_id = top.doc_id where rk <= 3"""
)
def clause_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every clause type the three chunks that its wordings find best, with neighbours."""
    v = query_variants(spark, sf_dir).select(F.concat("category", F.lit("#"), F.col("i").cast("string")).alias("query_id"), "category", "text")
    c = chunks(spark, sf_dir)
    scored = R.bm25(v, c.where("text is not null").select(F.col("chunk_id").alias("doc_id"), "text")).join(v.select("query_id", "category"), "query_id")
    top = R.ranked(scored.groupBy("category", "doc_id").agg(F.max("score").alias("score")), "category", "doc_id", 3)
    w = Window.partitionBy("doc_id").orderBy("chunk_id").rowsBetween(-1, 1)
    near = c.where("doc_id is not null").select("chunk_id", F.array_join(F.collect_list(F.coalesce("text", F.lit(""))).over(w), "\n\n").alias("context"))
    return top.select("category", F.col("doc_id").alias("chunk_id"), "score").join(near, "chunk_id").select("category", "chunk_id", "score", "context")


@named(
    f"""with p as (select contract_id, max(text) as text, max(form) as form, max(filing_date) as filing_date from contract_pool where contract_id is not null and text is not null group by contract_id),
    t as (select *, sha1({SQ.format('text')}) as content, case when {SQ.format('text')} = '' then 0 else len(string_split({SQ.format('text')}, ' ')) end as words from p), once as (select content, min(contract_id) as contract_id, max(words) as words from t where words >= 40 group by content)
    select contract_id, cast(words as int) as words from once order by contract_id limit 100"""
)
def acquired_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred contracts by name that are long enough, each text once."""
    p = read(spark, sf_dir, "contract_pool").where("contract_id is not null and text is not null").groupBy("contract_id").agg(F.max("text").alias("text"))
    t = p.select("contract_id", W.content_hash(F.col("text")).alias("content"), W.word_count(F.col("text")).alias("words")).where("words >= 40")
    return t.groupBy("content").agg(F.min("contract_id").alias("contract_id"), F.max("words").alias("words")).select("contract_id", "words").orderBy("contract_id").limit(100)


def generated(passages: DataFrame, generate) -> DataFrame:
    """(passage_id, question) for `passages(passage_id, text)`: `generate`, an expression or a
    pandas UDF of the text, answers in free text; its questions are found, each kept once, with
    the first passage. A passage it gives null for is skipped."""
    asked = passages.select("passage_id", F.explode(S.questions(generate(F.col("text")))).alias("question"))
    return asked.groupBy("question").agg(F.min("passage_id").alias("passage_id")).select("passage_id", "question")


@named(
    f"""with {DOCS}, a as (select doc_id, 'What is meant by ' || array_to_string(({tokens('text')})[1:3], ' ') || '?' as question from docs where len({tokens('text')}) > 0)
    select min(doc_id) as passage_id, question from a where length(question) > 10 group by question"""
)
def generated_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by a rule that stands for a model: one about each passage's first words."""
    d = documents(spark, sf_dir).select(F.col("doc_id").alias("passage_id"), "text")
    say = lambda t: F.when(F.size(W.tokenize(t)) > 0, F.concat(F.lit("Q1: What is meant by "), F.array_join(F.slice(W.tokenize(t), 1, 3), " "), F.lit("?\n")))
    return generated(d, say)


@named(f"with {JUDGED} select q.query_id, q.text from queries q where exists (select 1 from judged j where j.query_id = q.query_id and j.grade >= 3)")
def written_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged queries written as a JSON map and read again."""
    q = read(spark, sf_dir, "queries").join(judged(spark, sf_dir).where("grade >= 3").select("query_id").distinct(), "query_id", "left_semi")
    path = table_dir(spark, "map")
    files.write_map(q.select("query_id", "text"), "query_id", "text", path)
    return files.json_map(spark, path)


@named(f"with {JUDGED} select query_id, doc_id, grade from judged where query_id is not null and doc_id is not null")
def written_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judgements written a line a query and read again."""
    path = table_dir(spark, "judgements")
    files.write_judgements(judged(spark, sf_dir).where("query_id is not null and doc_id is not null"), path)
    back = files.json_lines(spark, path, "query_id string, docs map<string,int>")
    return back.select("query_id", F.explode("docs").alias("doc_id", "grade"))


@named(f"with {RECORDS} select rec_id, source, query, len(negatives) as negatives from recs where query is not null")
def written_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as a data set (Parquet, a folder a split) and as lines, and read again."""
    rows = records(spark, sf_dir, "source", "query", "negatives").where("query is not null")
    path = table_dir(spark, "dataset")
    files.write_dataset(rows, f"{path}/train")
    files.write_lines(files.read_dataset(spark, path, "train").select("rec_id", "source", "query", F.when(F.col("negatives").isNotNull(), F.size("negatives")).cast("long").alias("negatives")), f"{path}-lines")
    return files.json_lines(spark, f"{path}-lines", "rec_id long, source string, query string, negatives long")
