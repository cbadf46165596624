"""Registry of named queries: each takes (spark, sf_dir) and may carry equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}

# Views the SQL texts share.
# Of a key delivered again the last delivery counts; rows that agree in time are ordered by their values.
DOCS = "docs as (select distinct on (doc_id) doc_id, text, source, lang, contract_id, heading from documents where doc_id is not null and text is not null order by doc_id, loaded_at desc nulls last, text desc nulls last, source desc nulls last, lang desc nulls last)"
CHUNKS = "chunks as (select distinct on (chunk_id) * from chunk where chunk_id is not null order by chunk_id, text nulls first, doc_id nulls first, page nulls first)"
RECORDS = "recs as (select distinct on (rec_id) rec_id, source, query, positive, negatives, positive_grade, contract_id, split from training_record where rec_id is not null order by rec_id, loaded_at desc nulls last)"
EVIDENCE = "ev as (select distinct on (evidence_id) evidence_id, query_id, clause_type, doc_id, heading, contract_id, split from heading_evidence where evidence_id is not null order by evidence_id, loaded_at desc nulls last)"
JUDGED = "judged as (select query_id, doc_id, max(grade) as grade from qrels where grade is not null group by query_id, doc_id)"
TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def tokens(column: str) -> str:
    return TOKENS.format(column)


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def named(sql: str | None = None, name: str | None = None):
    def register(f: Callable) -> Callable:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = sql
        return f

    return register
