"""Mixing sources to target weights, by min-cost flow over membership patterns.

A document's pattern is the set of sources that hold its text.  Token totals by pattern
(at most 2^sources rows) make the network: pattern arcs carry what the documents hold once,
twice, ... at rising cost, pattern -> source arcs what a source may take of it, source arcs
the quota, slack arcs what stays missing.  Documents are then laid end to end in a seeded
order and every source takes its stretch of the laps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import tokens as T
from lexmill.llm.draw import lot, running
from lexmill.llm.flow import Network
from lexmill.session import cut
from lexmill.tables import read

SEED = 42
MOST_SOURCES = 62  # bits of a membership pattern


def folded(c: Column) -> Column:
    """A source name without case, outer blanks and differences of separators."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"[\s\p{Pd}_.]+", "_"), "^_+|_+$", "")


def route(patterns: dict[int, int], sources: list[tuple[str, float, int]], total: int) -> tuple[dict, dict]:
    """({(pattern, source number): tokens}, {source: tokens missing}) for the quotas
    target_share x total."""
    net, most = Network(), max([1, *(r for _, _, r in sources)])
    for p, held in patterns.items():
        takers = [k for k in range(len(sources)) if p >> k & 1]
        for lap in range(max([0, *(sources[k][2] for k in takers)])):
            net.arc("S", ("p", p), held, float(lap * lap + lap))
        for k in takers:
            net.arc(("p", p), ("s", k), held * sources[k][2], 0.0, key=(p, k))
    for k, (name, share, _) in enumerate(sources):
        quota = round(share * total)
        net.arc(("s", k), "T", quota)
        net.arc("S", ("s", k), quota, 10.0 * (most + 1) ** 2, key=("slack", name))
    net.solve("S", "T", sum(round(s * total) for _, s, _ in sources))
    flows = {(p, k): net.flow((p, k)) for p in patterns for k in range(len(sources)) if net.flow((p, k))}
    return flows, {name: net.flow(("slack", name)) for name, _, _ in sources}


def _documents(spark: SparkSession, sf_dir: str, names: list[str]) -> DataFrame:
    """(doc_id, source, tokens, pattern), one row a document."""
    docs = read(spark, sf_dir, "documents").where("doc_id is not null")
    docs = docs.select("doc_id", F.col("loaded_at").cast("timestamp_ntz").alias("loaded_at"), folded(F.col("source")).alias("source"), F.md5("text").alias("held"), "text")
    sized = T.counted(docs, "text", "doc_id", "loaded_at", "source", "held")
    last = sized.groupBy("doc_id").agg(F.max(F.struct("loaded_at", "tokens", "source", "held")).alias("p"))
    rows = cut(last.select("doc_id", "p.source", "p.held", "p.tokens"), "p8-documents")
    bit = F.lit(0).cast("long")
    for k, name in enumerate(names):
        bit = F.when(F.col("source") == name, F.lit(1 << k).cast("long")).otherwise(bit)
    rows = rows.withColumn("bit", bit)
    # Only texts that several documents hold can have a pattern beyond their own source.
    shared = rows.where("held is not null and bit > 0").groupBy("held").agg(F.bit_or("bit").alias("all"), F.bit_count(F.bit_or("bit")).alias("n")).where("n > 1").select("held", "all")
    out = rows.join(shared, "held", "left")
    return cut(out.select("doc_id", "source", "tokens", "bit", F.coalesce("all", "bit").alias("pattern")), "p8-patterns")


def _planned(spark: SparkSession, sf_dir: str):
    wanted = read(spark, sf_dir, "mix_targets").where("source is not null").dropDuplicates(["source"]).orderBy("source").collect()
    if len(wanted) > MOST_SOURCES:
        raise ValueError(f"at most {MOST_SOURCES} sources")
    sources = [(r["source"], r["target_share"] or 0.0, r["max_repeat"] or 0) for r in wanted]
    rows = _documents(spark, sf_dir, [s for s, _, _ in sources])
    sums = rows.groupBy("pattern", "bit").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).collect()
    total = sum(r["tokens"] for r in sums)
    patterns: dict[int, int] = {}
    for r in sums:
        if r["pattern"]:
            patterns[r["pattern"]] = patterns.get(r["pattern"], 0) + r["tokens"]
    own = {s[0]: sum(r["tokens"] for r in sums if r["bit"] == 1 << k) for k, s in enumerate(sources)}
    flows, missing = route(patterns, sources, total)
    return rows, sources, total, patterns, own, flows, missing


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen repeats: doc_id, source it is taken for, repeats, tokens of one copy.

    Documents with null or unknown source, or no tokens, are never taken; each row counts at
    most max_repeat times a source; tables without rows give none."""
    rows, _, _, patterns, _, flows, _ = plan = _planned(spark, sf_dir)
    return _mix(spark, rows, plan[1], patterns, flows)


def _mix(spark: SparkSession, rows: DataFrame, sources, patterns: dict[int, int], flows: dict) -> DataFrame:
    """Every source takes its stretch of each pattern's laps: the copies whose middle lies in
    it, which is the flow's quota to within half a document at either end."""
    stretches = []
    for p, held in patterns.items():
        at = 0
        for k, (name, _, _) in enumerate(sources):
            n = flows.get((p, k), 0)
            if n:
                stretches.append((p, name, at, at + n, held, -(-(at + n) // held)))
                at += n
    parts = spark.createDataFrame(stretches, "pattern long, taken_for string, lo long, hi long, held long, laps long")
    laps = parts.groupBy("pattern").agg(F.max("held").alias("held"), F.max("laps").alias("laps"))
    line = running(rows.where("pattern > 0 and tokens > 0").withColumn("_d", lot(SEED, "doc_id")), ["pattern"], "_d", ["doc_id"], F.col("tokens").cast("long"))
    line = line.join(laps, "pattern").withColumn("lap", F.explode(F.sequence(F.lit(0).cast("long"), F.col("laps") - 1)))
    middle = F.col("lap") * F.col("held") + F.col("_upto") - F.col("tokens") / 2
    taken = line.withColumn("middle", middle).drop("held", "laps").join(parts.drop("held", "laps"), "pattern").where("middle >= lo and middle < hi")
    return taken.groupBy("doc_id", F.col("taken_for").alias("source")).agg(F.count("*").alias("repeats"), F.max("tokens").alias("tokens"))


def lacking(own: dict[str, int], sources: list[tuple[str, float, int]], total: int) -> set[str]:
    """Sources whose own documents, max_repeat times, stay below target_share x total.

    Each source's own tokens go through the network as a pattern of its own; where slack has
    to flow the source is short. Quotas there are rounded up and the exact sum decides last,
    as a whole number missing can be a fraction of a token."""
    up = [(name, -(-share * total // 1) / total if total else 0.0, repeat) for name, share, repeat in sources]
    _, missing = route({1 << k: own[name] for k, (name, _, _) in enumerate(sources)}, up, total)
    return {name for name, share, repeat in sources if missing[name] > 0 and own[name] * repeat < share * total}


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source: target share, tokens held once and at most, quota, tokens the flow could not
    find, and the copies, tokens and share that the drawn mix (`p8_mix`) really gives it."""
    rows, sources, total, patterns, own, flows, missing = _planned(spark, sf_dir)
    short = lacking(own, sources, total)
    out = [(name, share, repeat, own[name], own[name] * repeat, round(share * total), missing[name], name in short) for name, share, repeat in sources]
    kinds = "source string, target_share double, max_repeat int, held long, at_most long, quota long, missing long, short boolean"
    drawn = _mix(spark, rows, sources, patterns, flows).groupBy("source").agg(F.sum("repeats").alias("copies"), F.sum(F.col("repeats") * F.col("tokens")).alias("tokens"))
    drawn = cut(drawn, "p8-drawn")  # a row a source
    whole = drawn.agg(F.sum("tokens")).first()[0] or 0
    told = spark.createDataFrame(out, kinds).join(drawn, "source", "left").fillna({"copies": 0, "tokens": 0})
    return told.withColumn("share", F.when(F.lit(whole) > 0, F.col("tokens") / F.lit(max(whole, 1))).otherwise(0.0))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources whose documents, each taken max_repeat times, stay below their quota."""
    _, sources, total, _, own, _, _ = _planned(spark, sf_dir)
    return spark.createDataFrame([(name,) for name in sorted(lacking(own, sources, total))], "source string")
