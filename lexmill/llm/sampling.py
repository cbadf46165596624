"""Samples that match target category proportions, by min-cost flow over cells.

Rows are only counted (category x split); the flow decides how many each cell gives:
source -> category arcs carry the floor and the target share, category -> cell arcs what is
there, cell -> split arcs the split's margin, and a slack arc past the cells what a category
lacks.  The rows of each cell's quota are then drawn by seed in the cluster.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.draw import lot, running
from lexmill.llm.flow import Network, apportion
from lexmill.session import cut
from lexmill.tables import read

SEED = 42
HALF = 0.5
MOST_TARGETS = 1_000  # categories, held on the driver and in the plan
TYPO = 2  # edits within which a spelling still is its nearest category


def folded(c: Column) -> Column:
    """A spelling without case, counts in brackets, end marks and separators."""
    s = F.lower(F.trim(c))
    s = F.regexp_replace(s, r"\s*[(\[]\s*\d+\s*[)\]]\s*$", "")
    return F.regexp_replace(s, r"[^\p{L}\p{N}]+", "_").alias("s")


def categories(evidence: DataFrame, queries: DataFrame, targets: DataFrame) -> DataFrame:
    """(evidence_id, category, split), one row an evidence_id.

    The category is the target whose name the folded clause_type spells, or is nearest to it
    within TYPO edits (at most a quarter of its letters; ties: first by name); failing that,
    the query's category; null if that fails too.  Of repeated deliveries the last counts.
    Null ids are left out."""
    spark = evidence.sparkSession
    last = evidence.where("evidence_id is not null").groupBy("evidence_id").agg(
        F.max(F.struct("loaded_at", "clause_type", "query_id", "split")).alias("p")
    )
    rows = last.select("evidence_id", "p.clause_type", "p.query_id", "p.split")
    rows = rows.withColumn("s", F.regexp_replace(folded(F.col("clause_type")), "^_+|_+$", ""))
    # Spellings are few beside rows: match each distinct one once, with every target.
    spelt = rows.where("s <> ''").select("s").distinct()
    names = sorted(r[0] for r in targets.select("clause_type").distinct().collect())
    if len(names) > MOST_TARGETS:
        raise ValueError(f"at most {MOST_TARGETS} targets")
    fold = F.regexp_replace(folded(F.col("category")), "^_+|_+$", "")
    named = spark.createDataFrame([(n,) for n in names], "category string").select("category", fold.alias("t")).collect()
    bare = lambda x: F.regexp_replace(x, "_", "")
    away = lambda t: F.least(F.levenshtein("s", F.lit(t)), F.levenshtein(bare(F.col("s")), F.lit(t.replace("_", ""))))
    near = [F.when((away(r["t"]) <= TYPO) & (away(r["t"]) * 4 <= len(r["t"])), F.struct(away(r["t"]).alias("d"), F.lit(r["category"]).alias("category"))) for r in named]
    best = spelt.withColumn("m", F.array_min(F.array_compact(F.array(*near))) if near else F.lit(None).cast("struct<d:int,category:string>")).where("m is not null")
    asked = queries.groupBy("query_id").agg(F.min("category").alias("asked"))
    out = rows.join(best.select("s", F.col("m.category").alias("own")), "s", "left").join(asked, "query_id", "left")
    return out.select("evidence_id", F.coalesce("own", "asked").alias("category"), F.coalesce("split", F.lit("none")).alias("split"))


def plan(cells: dict[tuple[str, str], int], targets: dict[str, tuple[float, int]], size: int) -> tuple[dict, dict]:
    """({(category, split): quota}, {category: shortfall}).

    The shortfall is what is missing to the larger of the floor and target_share x size, read
    off the slack arcs.  Quotas sum to min(size, rows there); what short categories cannot
    give, the others share at rising cost."""
    need = {c: max(floor, math.ceil(share * size - 1e-9)) for c, (share, floor) in targets.items()}
    there = {c: sum(n for (k, _), n in cells.items() if k == c) for c in targets}
    splits = sorted({s for _, s in cells})
    total = sum(there.values())
    margin = apportion({s: float(sum(n for (c, k), n in cells.items() if k == s and c in targets)) for s in splits}, min(size, total)) if splits else {}

    def network(wanted: dict[str, int], floors: dict[str, int], spill: bool, slack: bool) -> Network:
        net = Network()
        for c in targets:
            low = min(floors[c], wanted[c])
            net.arc("S", ("cat", c), low, -1000.0)
            net.arc("S", ("cat", c), wanted[c] - low, -100.0)
            if spill:
                step = max(1, wanted[c] // 10)
                for i in range(40):
                    net.arc("S", ("cat", c), step, 1.0 + i)
                net.arc("S", ("cat", c), total, 50.0)
            if slack:
                net.arc(("cat", c), "T", wanted[c], 500.0, key=("slack", c))
            for s in splits:
                net.arc(("cat", c), ("cell", c, s), cells.get((c, s), 0), 0.0, key=("cell", c, s))
                net.arc(("cell", c, s), ("split", s), cells.get((c, s), 0))
        for s in splits:
            net.arc(("split", s), "T", margin[s])
            net.arc(("split", s), "T", total, 0.5)
        return net

    asked = network(need, {c: t[1] for c, t in targets.items()}, False, True)
    asked.solve("S", "T", sum(need.values()))
    short = {c: asked.flow(("slack", c)) for c in targets}

    floors = {c: min(f, there[c]) for c, (_, f) in targets.items()}
    wanted = apportion({c: t[0] for c, t in targets.items()}, size)
    wanted = {c: max(wanted[c], floors[c]) for c in targets}
    drawn = network(wanted, floors, True, False)
    drawn.solve("S", "T", min(size, total))
    return {(c, s): drawn.flow(("cell", c, s)) for c in targets for s in splits if drawn.flow(("cell", c, s))}, short


def _planned(spark: SparkSession, sf_dir: str):
    targets = read(spark, sf_dir, "clause_targets").where("clause_type is not null").dropDuplicates(["clause_type"])
    rows = cut(categories(read(spark, sf_dir, "heading_evidence"), read(spark, sf_dir, "queries"), targets), "p5-rows")
    cells = {(r["category"], r["split"]): r["n"] for r in rows.groupBy("category", "split").agg(F.count("*").alias("n")).collect()}
    wanted = {r["clause_type"]: (r["target_share"] or 0.0, r["min_rows"] or 0) for r in targets.collect()}
    size = sum(cells.values()) // 2
    quota, short = plan(cells, wanted, size)
    return rows, wanted, size, cells, quota, short


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The drawn rows: evidence_id, category, split. Nothing is drawn from an empty table."""
    rows, _, _, _, quota, _ = _planned(spark, sf_dir)
    q = spark.createDataFrame([(c, s, n) for (c, s), n in quota.items()], "category string, split string, quota long")
    ranked = running(rows.withColumn("_d", lot(SEED, "evidence_id")), ["category", "split"], "_d", ["evidence_id"])
    return ranked.join(q, ["category", "split"]).where("_upto <= quota").select("evidence_id", "category", "split")


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per category: target share, floor, rows there, rows drawn, share drawn, shortfall."""
    _, wanted, size, cells, quota, short = _planned(spark, sf_dir)
    drawn = sum(quota.values())
    out = []
    for c, (share, floor) in sorted(wanted.items()):
        got = sum(n for (k, _), n in quota.items() if k == c)
        out.append((c, share, floor, sum(n for (k, _), n in cells.items() if k == c), got, round(got / drawn, 6) if drawn else 0.0, short[c]))
    return spark.createDataFrame(out, "clause_type string, target_share double, min_rows int, there long, drawn long, drawn_share double, shortfall long")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories that fall short of the larger of floor and target share x size."""
    return p5_report(spark, sf_dir).where("shortfall > 0").select("clause_type")
