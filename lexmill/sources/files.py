"""Scans and sinks of the on-disk shapes of retrieval data: JSON maps, line files, TSV, archives.

Scans are lazy DataFrames; a JSON document of any size is one row that Spark explodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException


def _documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole JSON documents with the name of their file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")


def json_map(spark: SparkSession, path: str | list[str], key: str = "query_id", value: str = "text") -> DataFrame:
    """{key: text} -> (key, text)."""
    return _documents(spark, path).select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))


def judgements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """{query: {document: grade}} -> (query_id, doc_id, grade)."""
    outer = _documents(spark, path).select(F.explode(F.from_json("value", "map<string,map<string,int>>")).alias("query_id", "m"))
    return outer.select("query_id", F.explode("m").alias("doc_id", "grade"))


def splits(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the splits for which `folder` has queries, corpus and judgements."""
    kinds = ("queries", "corpus", "qrels")
    names = None
    for kind in kinds:
        files = spark.read.format("binaryFile").option("pathGlobFilter", f"*_{kind}.json").load(folder).select("path")
        found = files.select(F.regexp_extract("path", rf"([^/]+)_{kind}\.json$", 1).alias("split")).distinct()
        names = found if names is None else names.join(found, "split")
    return names


def gate(spark: SparkSession, folder: str, name: str) -> dict[str, DataFrame]:
    """The tables of one evaluation gate; categories may be absent (then the table is empty)."""
    at = lambda kind: f"{folder}/{name}_{kind}.json"
    out = {"queries": json_map(spark, at("queries")), "corpus": json_map(spark, at("corpus"), "doc_id"), "qrels": judgements(spark, at("qrels"))}
    try:
        out["categories"] = json_map(spark, at("categories"), "query_id", "category")
    except AnalysisException:
        out["categories"] = spark.createDataFrame([], "query_id string, category string")
    return out


def json_lines(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One object a line; blank and malformed lines drop out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def judgement_rows(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Tab-separated judgements with a header: query-id, corpus-id, score."""
    rows = spark.read.option("sep", "\t").option("header", True).schema("query_id string, doc_id string, grade int").csv(path)
    return rows.where("query_id is not null and doc_id is not null")


def benchmark_folder(spark: SparkSession, folder: str, split: str) -> dict[str, DataFrame]:
    """corpus.jsonl, queries.jsonl and qrels/<split>.tsv; a title goes before its text, a
    missing split has no rows."""
    c = json_lines(spark, f"{folder}/corpus.jsonl", "_id string, title string, text string")
    q = json_lines(spark, f"{folder}/queries.jsonl", "_id string, text string")
    try:
        j = judgement_rows(spark, f"{folder}/qrels/{split}.tsv")
    except AnalysisException:
        j = spark.createDataFrame([], "query_id string, doc_id string, grade int")
    text = F.concat_ws("\n", F.nullif(F.trim("title"), F.lit("")), "text")
    return {"corpus": c.select(F.col("_id").alias("doc_id"), text.alias("text")), "queries": q.select(F.col("_id").alias("query_id"), "text"), "qrels": j}


def first_of(*names: str):
    """The first of several field names that holds something."""
    return F.coalesce(*[F.nullif(F.trim(n), F.lit("")) for n in names])


def labelled_clauses(spark: SparkSession, path: str | list[str], least_words: int = 12) -> DataFrame:
    """A JSON list of clauses under alternative field names -> (text, label)."""
    from lexmill.functions.words import label_name, word_count

    shape = "array<struct<clause_text:string,text:string,clause:string,clause_type:string,category:string,type:string>>"
    rows = _documents(spark, path).select(F.explode(F.from_json("value", shape)).alias("r")).select("r.*")
    out = rows.select(first_of("clause_text", "text", "clause").alias("text"), label_name(first_of("clause_type", "category", "type")).alias("label"))
    return out.where(word_count(F.col("text")) >= least_words).where("label is not null")


def generated_pairs(spark: SparkSession, paths: list[str], least_chars: int = 11) -> DataFrame:
    """JSON lists of generated (query, positive) pairs; a missing file is skipped."""
    out = spark.createDataFrame([], "query string, positive string")
    for path in paths:
        try:
            rows = _documents(spark, path).select(F.explode(F.from_json("value", "array<struct<query:string,question:string,positive:string,passage:string>>")).alias("r")).select("r.*")
        except AnalysisException:
            continue
        out = out.unionByName(rows.select(first_of("query", "question").alias("query"), first_of("positive", "passage").alias("positive")))
    return out.where((F.length("query") >= least_chars) & F.col("positive").isNotNull())


def answered(rows: DataFrame) -> DataFrame:
    """QA rows (question, context, answers{text, answer_start}) that have an answer and a
    context, with the first answer and its place."""
    kept = rows.where((F.size("answers.text") > 0) & (F.trim("context") != ""))
    return kept.select("id", "title", "question", "context", F.col("answers.text")[0].alias("answer"), F.col("answers.answer_start")[0].alias("start"))


def named_labels(rows: DataFrame, names: list[str], label: str = "label") -> DataFrame:
    """Integer labels to names; labels outside the list are null."""
    return rows.withColumn(label, F.try_element_at(F.array(*[F.lit(n) for n in names]), F.col(label) + 1))


def one_or_many(column):
    """A field that is text or a JSON list of texts -> array."""
    listed = F.from_json(column, "array<string>")
    return F.when(F.startswith(F.trim(column), F.lit("[")), listed).when(column.isNotNull(), F.array(column))


def configurations(spark: SparkSession, paths: dict[str, str], wanted: list[str], schema: str) -> DataFrame:
    """Union of one JSON-lines file per configuration, named in `config`; a wanted one that
    is missing is an error."""
    missing = sorted(set(wanted) - set(paths))
    if missing:
        raise ValueError(f"no file for {', '.join(missing)}")
    out = None
    for name in wanted:
        rows = json_lines(spark, paths[name], schema).withColumn("config", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def parallel_arrays(rows: DataFrame, *columns: str, forms: list[str] | None = None) -> DataFrame:
    """Parallel array columns -> one row a position; `forms` keeps rows whose form is listed."""
    out = rows.select(F.inline(F.arrays_zip(*columns)))
    return out.where(F.col("form").isin(forms)) if forms is not None else out


def buckets(spark: SparkSession, path: str) -> DataFrame:
    """{subtype: {family, guard, texts}} -> (subtype, family, guard, text)."""
    shape = "map<string,struct<family:string,guard:string,texts:array<string>>>"
    rows = _documents(spark, path).select(F.explode(F.from_json("value", shape)).alias("subtype", "b"))
    return rows.select("subtype", "b.family", "b.guard", F.explode("b.texts").alias("text"))


def contract_texts(spark: SparkSession, path: str) -> DataFrame:
    """Either [{contract, text}] or {contract: text} -> (contract, text)."""
    d = _documents(spark, path)
    listed = d.where(F.startswith(F.ltrim("value"), F.lit("["))).select(F.explode(F.from_json("value", "array<struct<contract:string,text:string>>")).alias("r")).select("r.contract", "r.text")
    mapped = d.where(F.startswith(F.ltrim("value"), F.lit("{"))).select(F.explode(F.from_json("value", "map<string,string>")).alias("contract", "text"))
    return listed.unionByName(mapped)


def write_map(rows: DataFrame, key: str, value: str, path: str) -> None:
    """(key, value) as one JSON object a partition: for small report tables."""
    one = rows.coalesce(1).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, value))))).alias("value"))
    one.write.mode("overwrite").text(path)


def write_judgements(rows: DataFrame, path: str) -> None:
    """(query_id, doc_id, grade) as JSON lines, one query a line; judgements of a query are
    bounded by what people judge."""
    by = rows.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("doc_id", "grade")))).alias("docs"))
    by.write.mode("overwrite").json(path)


def write_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_dataset(rows: DataFrame, path: str) -> None:
    """A data set, one folder a split."""
    rows.write.mode("overwrite").parquet(path)


def read_dataset(spark: SparkSession, folder: str, split: str | None = None) -> DataFrame:
    """One split of a data set, or all of them with their name in `split`."""
    if split is not None:
        return spark.read.parquet(f"{folder}/{split}")
    rows = spark.read.parquet(f"{folder}/*")
    return rows.withColumn("split", F.regexp_extract("_metadata.file_path", r"/([^/]+)/[^/]+$", 1))


def report(rows: DataFrame, most: int = 1000) -> str:
    """A small table as text in columns; refused when it has more than `most` rows."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows")
    cells = [rows.columns, *[["" if v is None else str(v) for v in r] for r in got]]
    wide = [max(len(r[i]) for r in cells) for i in range(len(rows.columns))]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, wide)).rstrip() for r in cells)


def write_index(chunks: DataFrame, path: str) -> None:
    """Chunks with their vectors, as Parquet; `read_index` is its scan."""
    chunks.write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def union_loose(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Union by name; columns that a table lacks are null."""
    for df in more:
        first = first.unionByName(df, allowMissingColumns=True)
    return first
