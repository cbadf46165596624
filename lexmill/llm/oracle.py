"""SQL of those queries that SQL can express on whole tables."""

from lexmill.llm.sampling import TYPO

_SHAPE = r"(\d{10})[-_]?(\d{2})[-_]?(\d{6})[-_/]([^/]+?)(?:\.html?|\.txt|\.pdf)?/?$"


def _key(column: str) -> str:
    c = rf"lower(regexp_replace(url_decode({column}), '[\s\p{{Z}}]+', '', 'g'))"
    part = [f"regexp_extract({c}, '{_SHAPE}', {i})" for i in range(1, 5)]
    fold = lambda x: rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g')"
    return f"case when {part[0]} <> '' then {part[0]} || {part[1]} || {part[2]} || ':' || {fold(part[3])} else {fold(c)} end"


P1_FOUND = rf"""with pool as (select distinct contract_id, {_key('contract_id')} as key, coalesce(nullif(regexp_replace(text, '[\s\p{{Z}}]+', '', 'g'), ''), 'own ' || contract_id) as grp from contract_pool where contract_id is not null),
    seen as (select contract_id, split from training_record where split is not null and contract_id is not null union select contract_id, split from heading_evidence where split is not null and contract_id is not null),
    torn as (select grp from (select distinct {_key('contract_id')} as key, split from seen) join (select distinct key, grp from pool) using (key) group by grp having count(distinct split) > 1)
    select contract_id from pool where grp in (select grp from torn) group by contract_id"""

_FOLD = r"regexp_replace(regexp_replace(regexp_replace(lower(trim(clause_type)), '\s*[(\[]\s*\d+\s*[)\]]\s*$', ''), '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g')"

P5_FOUND = f"""with last as (select evidence_id, arg_max({{'c': clause_type, 'q': query_id}}, loaded_at) as p from heading_evidence where evidence_id is not null group by evidence_id),
    rows_ as (select evidence_id, p.q as query_id, (select {_FOLD} from (select p.c as clause_type)) as s from last),
    best as (select s, arg_min(clause_type, struct_pack(d := d, c := clause_type)) as category from (select s, clause_type, least(levenshtein(s, clause_type), levenshtein(replace(s, '_', ''), replace(clause_type, '_', ''))) as d
    from (select distinct s from rows_ where s <> ''), clause_targets) where d <= {TYPO} and d * 4 <= length(clause_type) group by s),
    named as (select evidence_id, coalesce(best.category, q.category) as category from rows_ left join best using (s) left join queries q using (query_id)),
    size as (select count(*) // 2 as size from named), counted as (select category, count(*) as n from named group by category)
    select clause_type from clause_targets left join counted on category = clause_type cross join size where coalesce(n, 0) < greatest(min_rows, target_share * size - 1e-9)"""

ORACLE = {"p1_found": P1_FOUND, "p5_found": P5_FOUND}
