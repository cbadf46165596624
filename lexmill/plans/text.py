"""Text queries: words, overlaps, labels, windows, sentences, noise, identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import segments as S
from lexmill.functions import words as W
from lexmill.plans.base import chunks, documents, evidence, records
from lexmill.plans.registry import CHUNKS, DOCS, EVIDENCE, RECORDS, named, sql_list, tokens
from lexmill.tables import read

STOP, BOTH = sql_list(W.STOPWORDS), sql_list(W.STOPWORDS + W.TEMPLATE_WORDS)
SQ = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
KEYS = "list_distinct(list_filter({t}, lambda w: not list_contains({stop}, w){more}))"


def _keys(column: str) -> str:
    return KEYS.format(t=tokens(column), stop=STOP, more=" and length(w) > 2")


@named(f"with {DOCS} select doc_id, cast(len(t) as int) as n_tokens, cast(len(list_distinct(t)) as int) as n_distinct from (select doc_id, {tokens('text')} as t from docs)")
def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = documents(spark, sf_dir).select("doc_id", W.tokenize(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@named(f"with {DOCS} select doc_id, cast(len(t) as int) as n_topical, cast(len(list_distinct(t)) as int) as n_keywords from (select doc_id, list_filter({tokens('text')}, lambda w: not list_contains({STOP}, w) and length(w) > 2) as t from docs)")
def stop_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = documents(spark, sf_dir).select("doc_id", W.topical(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n_topical"), F.size(F.array_distinct("t")).alias("n_keywords"))


@named(
    f"""with {RECORDS}, k as (select rec_id, {_keys('query')} as q, {tokens('positive')} as w from recs where query is not null and positive is not null),
    o as (select rec_id, case when len(q) > 0 then len(list_intersect(q, w)) / len(q) else 0.0 end as o from k)
    select rec_id, round(o, 6) as overlap, o <= 0.75 as kept from o"""
)
def keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a query's keywords that its positive holds, and the predicate over it."""
    rows = records(spark, sf_dir, "query", "positive").where("query is not null and positive is not null")
    rows = rows.select("rec_id", W.overlap(W.keyword_set(F.col("query")), F.col("positive")).alias("o"))
    return rows.select("rec_id", F.round("o", 6).alias("overlap"), (F.col("o") <= 0.75).alias("kept"))


@named(
    f"""with {RECORDS}, k as (select rec_id, {KEYS.format(t=tokens('query'), stop=BOTH, more='')} as q, {tokens('positive')} as w from recs where query is not null and positive is not null),
    o as (select rec_id, case when len(q) > 0 then len(list_intersect(q, w)) / len(q) else 0.0 end as o from k)
    select rec_id, round(o, 6) as overlap, o <= 0.6 as kept from o"""
)
def template_keyword_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "query", "positive").where("query is not null and positive is not null")
    rows = rows.select("rec_id", W.overlap(W.query_keywords(F.col("query")), F.col("positive")).alias("o"))
    return rows.select("rec_id", F.round("o", 6).alias("overlap"), (F.col("o") <= 0.6).alias("kept"))


_SET = r"list_distinct(list_filter(string_split(trim(regexp_replace(lower({0}), '\s+', ' ', 'g')), ' '), lambda w: w <> ''))"


@named(
    f"""with {RECORDS}, s as (select rec_id, {_SET.format('query')} as a, {_SET.format('positive')} as b from recs where query is not null and positive is not null)
    select rec_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) as jaccard from s where len(a) > 0 and len(b) > 0"""
)
def word_set_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "query", "positive").where("query is not null and positive is not null")
    out = rows.select("rec_id", F.round(W.jaccard(W.word_set(F.col("query")), W.word_set(F.col("positive"))), 6).alias("jaccard"))
    return out.where("jaccard is not null")


@named(
    rf"""with {DOCS}, c as (select doc_id, case when {SQ.format('text')} = '' then 0 else len(string_split({SQ.format('text')}, ' ')) end as words, len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) as terms, length(text) as chars from docs)
    select doc_id, cast(words as int) as words, cast(terms as int) as terms, cast(floor(words * 1.4::double) as int) as est_tokens from c where words between 10 and 320 and terms >= 5 and chars > 50"""
)
def word_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages within the word band, with both word counts and the token estimate."""
    t = F.col("text")
    rows = documents(spark, sf_dir).select("doc_id", W.word_count(t).alias("words"), W.regex_word_count(t).alias("terms"), F.length(t).alias("chars"))
    kept = rows.where("words between 10 and 320 and terms >= 5 and chars > 50")
    return kept.select("doc_id", "words", "terms", W.estimated_tokens(F.col("words")).alias("est_tokens"))


@named(f"with {DOCS} select sha1({SQ.format('text')}) as content, min(doc_id) as doc_id, count(*) as copies from docs where {SQ.format('text')} <> '' group by 1")
def normalize_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First document of each content, spacing apart, and how often it comes."""
    rows = read(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
    rows = rows.where(W.squeeze(F.col("text")) != "").select("doc_id", "loaded_at", W.content_hash(F.col("text")).alias("content"))
    once = rows.groupBy("doc_id").agg(F.max(F.struct("loaded_at", "content")).alias("p")).select("doc_id", "p.content")
    return once.groupBy("content").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@named(f"with {DOCS} select distinct 'doc-' || substr(sha1(text), 1, 16) as passage_id, sha1({SQ.format('text')}) as content from docs")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    rows = read(spark, sf_dir, "documents").where("doc_id is not null and text is not null")
    return rows.select(W.stable_id("doc", t).alias("passage_id"), W.content_hash(t).alias("content")).distinct()


_LABEL = r"regexp_replace(regexp_replace(lower(trim(clause_type)), '[_\-]+', ' ', 'g'), '\s+', ' ', 'g')"
_NAMES = " ".join(f"when '{k}' then '{v}'" for k, v in W.LABEL_NAMES.items())


@named(f"with {EVIDENCE} select evidence_id, case {_LABEL} {_NAMES} else {_LABEL} end as label from ev where clause_type is not null")
def label_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evidence(spark, sf_dir, "clause_type").where("clause_type is not null")
    return rows.select("evidence_id", W.label_name(F.col("clause_type")).alias("label"))


_CQ = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim({0}), '[-: ]*Answer$', ''), '\(Y/N\)', '', 'g'), '[_\-]+', ' ', 'g'), '\s+', ' ', 'g'))"


@named(
    f"""with q as (select query_id, {_CQ.format("text || ' (Y/N)-Answer'")} as q, {_CQ.format('category')} as t from queries),
    f as (select query_id, concat_ws('. ', nullif(q, ''), 'focus: ' || t, case when t <> '' and not contains(lower(q), lower(t)) then 'clause type: ' || t end) as first, t from q)
    select query_id, concat_ws('. ', nullif(first, ''), case when t <> '' and not contains(lower(first), lower(t)) then 'category: ' || t end) as query from f"""
)
def question_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query texts put together from question, focus, clause type and category."""
    q = read(spark, sf_dir, "queries").select("query_id", F.concat("text", F.lit(" (Y/N)-Answer")).alias("q"), "category")
    return q.select("query_id", W.question_query(F.col("q"), F.col("category"), F.col("category"), F.col("category")).alias("query"))


@named(
    """with q as (select query_id, category, 'Find provisions related to "' || category || '".' as template, text from queries)
    select query_id, template, coalesce(nullif(regexp_extract(template, 'related to "([^"]+)"', 1), ''), substr(trim(text), 1, 60)) as from_template,
    coalesce(nullif(regexp_extract(text, 'related to "([^"]+)"', 1), ''), substr(trim(text), 1, 60)) as from_text from q"""
)
def category_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = read(spark, sf_dir, "queries").withColumn("template", W.template_query(F.col("category")))
    first = F.substring(F.trim("text"), 1, 60)
    return q.select("query_id", "template", W.quoted_category(F.col("template"), first).alias("from_template"), W.quoted_category(F.col("text"), first).alias("from_text"))


@named(
    r"""with p as (select contract_id, max(text) as text from contract_pool where contract_id is not null and text is not null group by 1),
    m as (select contract_id, text, position('shall' in text) - 1 as s from p where contains(text, 'shall')),
    b as (select *, greatest(s - 100, 0) as lo, least(s + 105, length(text)) as hi from m),
    h as (select *, substr(text, 1, lo) as head, substr(text, hi + 1) as tail from b)
    select contract_id, trim(substr(text, lo + 1, hi - lo), ' ') as fixed,
    regexp_replace((case when regexp_matches(head, '[ \n]') then regexp_extract(head, '[^ \n]*$') else '' end) || substr(text, lo + 1, hi - lo) ||
    (case when regexp_matches(tail, '[ \n]') then regexp_extract(tail, '^[^ \n]*') else '' end), '^\s+|\s+$', '', 'g') as aligned from h"""
)
def window_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed and word-aligned windows around the first duty of each contract."""
    p = read(spark, sf_dir, "contract_pool").where("contract_id is not null and text is not null")
    p = p.groupBy("contract_id").agg(F.max("text").alias("text")).where(F.contains("text", F.lit("shall")))
    s = F.locate("shall", F.col("text")) - 1
    t = F.col("text")
    return p.select("contract_id", S.window(t, s, F.lit(5), 100).alias("fixed"), S.aligned_window(t, s, F.lit(5), 100).alias("aligned"))


_PAGE = """'<html><script>var x = 1;</script><body><h1>' || coalesce(heading, 'x') || '</h1><p class="a">' || replace(replace(text, '&', '&amp;'), '<', '&lt;') || '</p><br/>end</body></html>'"""


@named(
    rf"""with {DOCS}, h as (select doc_id, {_PAGE} as page from docs),
    a as (select doc_id, regexp_replace(page, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g') as t from h),
    b as (select doc_id, regexp_replace(regexp_replace(t, '(?i)<(br|/?(p|div|tr|li|h[1-4]))(\s[^>]*)?/?>', chr(10), 'g'), '<[^>]+>', '', 'g') as t from a),
    c as (select doc_id, replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&amp;', '&') as t from b),
    d as (select doc_id, regexp_replace(regexp_replace(regexp_replace(t, '[ \t\r\f\x0B]+', ' ', 'g'), '\n[ \t]+', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') as t from c)
    select doc_id, regexp_replace(t, '^\s+|\s+$', '', 'g') as plain from d"""
)
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir, "text", "heading")
    page = F.concat(
        F.lit("<html><script>var x = 1;</script><body><h1>"), F.coalesce("heading", F.lit("x")), F.lit('</h1><p class="a">'),
        F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p><br/>end</body></html>"),
    )
    return d.select("doc_id", S.html_to_text(page).alias("plain"))


@named(
    rf"""with {DOCS} select doc_id, regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '(?m)^\d+\s*$|^\(NY\)\s+\d+/.*\.doc\s*$', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as cleaned from docs"""
)
def noise_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without page-number lines."""
    d = documents(spark, sf_dir)
    return d.select("doc_id", S.clean_text(F.col("text")).alias("cleaned"))


def _sentences_sql(column: str) -> str:
    t = column
    for a in S.ABBREVIATIONS:
        t = f"replace({t}, '{a}.', '{a.replace('.', S.HELD)}{S.HELD}')"
    t = rf"regexp_replace({t}, '(\d+)\.(\d+)\.', '\1{S.HELD}\2{S.HELD}', 'g')"
    t = rf"string_split(regexp_replace({t}, '([.;:!?])\s+', '\1' || chr(31), 'g'), chr(31))"
    return rf"list_filter(list_transform({t}, lambda s: regexp_replace(replace(s, '{S.HELD}', '.'), '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


@named(f"with {DOCS} select doc_id, cast(len(s) as int) as n, s[1] as head, s[-1] as tail from (select doc_id, {_sentences_sql('text')} as s from docs) where len(s) > 0")
def mark_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences by marks, abbreviations protected: number, first and last."""
    d = documents(spark, sf_dir).select("doc_id", S.sentences(F.col("text")).alias("s")).where(F.size("s") > 0)
    return d.select("doc_id", F.size("s").alias("n"), F.element_at("s", 1).alias("head"), F.element_at("s", -1).alias("tail"))


@named(
    rf"""with {DOCS}, w as (select doc_id, list_filter(string_split({SQ.format('text')}, ' '), lambda w: w <> '') as w from docs),
    k as (select doc_id, w, unnest(range(0, 1 + cast(greatest(0, ceil((len(w) - 32) / 17.0)) as bigint))) as k from w where len(w) > 0)
    select doc_id, cast(k as int) as k, array_to_string(w[k * 17 + 1 : k * 17 + 32], ' ') as piece from k"""
)
def long_sentence_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = documents(spark, sf_dir).select("doc_id", F.posexplode(S.word_windows(F.col("text"), 50)).alias("k", "piece"))
    return d.select("doc_id", "k", "piece")


def _pieces_sql(pattern: str, column: str) -> str:
    return rf"string_split(regexp_replace({column}, '{pattern}', chr(31) || '\0', 'g'), chr(31))"


@named(
    rf"""with {DOCS}, p as (select doc_id, {_pieces_sql(r'(?m)^\s*(\([a-z]\)|\([ivxlc]+\)|\(\d+\))\s+', "replace(text, ' (', chr(10) || '(')")} as parts from docs),
    u as (select doc_id, unnest(parts) as body from p)
    select doc_id, count(*) as n_parts, cast(max(length(body)) as int) as longest from u where trim(regexp_replace(body, '\s+', '', 'g')) <> '' group by doc_id"""
)
def structural_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at item markers such as (a), (ii), (3)."""
    d = documents(spark, sf_dir).select("doc_id", F.explode(S.pieces(F.replace("text", F.lit(" ("), F.lit("\n(")), S.SUBSECTION)).alias("p"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n_parts"), F.max(F.length("p.body")).alias("longest"))


@named(
    rf"""with {DOCS} select doc_id, cast(len(regexp_extract_all(text, '(?m)^ARTICLE\s+(?:\d+|[IVXLC]+)')) as int) as articles, cast(len(regexp_extract_all(text, 'Section\s+\d+\.\d+')) as int) as sections,
    cast(len(regexp_extract_all(text, '(?m)^["“][^"”]+["”](?::|\s+means?\b)')) as int) as definitions, regexp_matches(text, '\.{{5,}}') as leaders,
    len(regexp_extract_all(text, '(?m)^ARTICLE\s+(?:\d+|[IVXLC]+)')) >= 2 or len(regexp_extract_all(text, 'Section\s+\d+\.\d+')) >= 3 as structured from docs"""
)
def structure_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    d = documents(spark, sf_dir).select(
        "doc_id",
        F.regexp_count(t, F.lit(r"(?m)^ARTICLE\s+(?:\d+|[IVXLC]+)")).alias("articles"),
        F.regexp_count(t, F.lit(r"Section\s+\d+\.\d+")).alias("sections"),
        F.regexp_count(t, F.lit('(?m)^["“][^"”]+["”](?::|\\s+means?\\b)')).alias("definitions"),
        F.rlike(t, F.lit(S.LEADERS)).alias("leaders"),
    )
    return d.withColumn("structured", (F.col("articles") >= 2) | (F.col("sections") >= 3))


@named(
    """with e as (select event_id, 'Here: ```json' || chr(10) || props || chr(10) || '```' as said from events where props is not null)
    select event_id, cast(json_extract(regexp_extract(said, '(?s)```(?:json)?\\s*(.*?)```', 1), '$.k') as bigint) as k from e"""
)
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of the JSON value found in free text."""
    e = read(spark, sf_dir, "events").where("props is not null")
    said = F.concat(F.lit("Here: ```json\n"), "props", F.lit("\n```"))
    return e.select("event_id", F.from_json(S.first_json(said), "k bigint")["k"].alias("k"))


@named(
    r"""with q as (select category, string_agg(row_number || '. ' || text, chr(10) order by query_id) as said from (select *, row_number() over (partition by category order by query_id) as row_number from queries) group by category),
    n as (select category, list_filter(list_transform(regexp_extract_all(said, '(?m)^\s*\d+\.\s+(.+?)$', 1), lambda s: trim(s)), lambda s: length(s) > 10 and s like '%?') as n from q)
    select category, cast(len(n) as int) as asked from n"""
)
def question_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions found in numbered lists of generated text."""
    from pyspark.sql import Window

    q = read(spark, sf_dir, "queries").withColumn("i", F.row_number().over(Window.partitionBy("category").orderBy("query_id")))
    q = q.groupBy("category").agg(F.array_sort(F.collect_list(F.struct("query_id", F.concat(F.col("i").cast("string"), F.lit(". "), "text").alias("t")))).alias("l"))
    said = F.array_join(F.transform("l", lambda x: x["t"]), "\n")
    return q.select("category", F.size(S.questions(said)).alias("asked"))


@named(
    """with p as (select contract_id, max(accession) as accession, max(cik) as cik, max(document) as document, max(description) as description, max(text) as text from contract_pool where contract_id is not null group by 1)
    select contract_id, replace(accession, '-', '') as accession_path, lpad(cast(cik as varchar), 10, '0') as cik10,
    (lower(document) like '%.htm' or lower(document) like '%.html' or lower(document) like '%.txt') as readable,
    not contains(lower(document || ' ' || coalesce(description, '')), 'graphic') and not contains(lower(document || ' ' || coalesce(description, '')), 'calculation')
    and (regexp_matches(lower(document || ' ' || coalesce(description, '')), '\\bex(?:hibit)?[-_\\s]?10(?:[\\.\\-_]\\d+)?\\b') or regexp_matches(lower(coalesce(description, '')), '\\b10(?:[\\.\\-_]\\d+)?\\b')) as exhibit,
    case when length(text) > 200 then substr(text, 1, 200) || '...' else text end as preview from p where document is not null"""
)
def filing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived paths, padded numbers, document-type and file-ending predicates, previews."""
    p = read(spark, sf_dir, "contract_pool").where("contract_id is not null").groupBy("contract_id").agg(*[F.max(c).alias(c) for c in ("accession", "cik", "document", "description", "text")])
    both = F.lower(F.concat("document", F.lit(" "), F.coalesce("description", F.lit(""))))
    name = F.lower("document")
    exhibit = ~F.contains(both, F.lit("graphic")) & ~F.contains(both, F.lit("calculation")) & (
        F.rlike(both, F.lit(r"\bex(?:hibit)?[-_\s]?10(?:[\.\-_]\d+)?\b")) | F.rlike(F.lower(F.coalesce("description", F.lit(""))), F.lit(r"\b10(?:[\.\-_]\d+)?\b"))
    )
    return p.where("document is not null").select(
        "contract_id", F.replace("accession", F.lit("-"), F.lit("")).alias("accession_path"), F.lpad(F.col("cik").cast("string"), 10, "0").alias("cik10"),
        (F.endswith(name, F.lit(".htm")) | F.endswith(name, F.lit(".html")) | F.endswith(name, F.lit(".txt"))).alias("readable"), exhibit.alias("exhibit"),
        F.when(F.length("text") > 200, F.concat(F.substring("text", 1, 200), F.lit("..."))).otherwise(F.col("text")).alias("preview"),
    )


@named(
    f"""with {CHUNKS}
    select chunk_id, array_to_string(section_path, ' > ') as header, case when len(section_path) > 0 then '[' || array_to_string(section_path, ' > ') || ']' || chr(10) || text else text end as full_text, metadata['lang'] as language from chunks where text is not null"""
)
def chunk_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Section header, text under its header, and a metadata value whatever its key's case."""
    c = chunks(spark, sf_dir).where("text is not null")
    header = F.concat_ws(" > ", "section_path")
    full = F.when(F.size("section_path") > 0, F.concat(F.lit("["), header, F.lit("]\n"), "text")).otherwise(F.col("text"))
    return c.select("chunk_id", header.alias("header"), full.alias("full_text"), W.any_key(F.col("metadata"), "Lang", "LANG").alias("language"))


@named(
    """select source, initcap_.label as label, source like 'graded%' or source like 'q?_%' or source like 'qa_%' as picked
    from (select distinct source from training_record where source is not null) s,
    lateral (select array_to_string(list_transform(string_split(regexp_replace(case when source like 'graded_%' then substr(source, 8) else source end, '[_-]', ' ', 'g'), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') as label) initcap_"""
)
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable names of sources, and shell-pattern and prefix predicates over them."""
    s = read(spark, sf_dir, "training_record").where("source is not null").select("source").distinct()
    return s.select("source", W.task_label(F.col("source"), "graded_").alias("label"), W.glob_match(F.col("source"), ["graded*", "qa_*"]).alias("picked"))
