"""The pair operators on whole small tables, against every pair compared."""

from itertools import combinations

import numpy as np
import pytest

from lexmill.llm import groups, neardup, overlap, words


def latest(spark, small):
    rows = spark.read.parquet(f"{small}/training_record.parquet").where("rec_id is not null").toPandas()
    return rows.sort_values("loaded_at", na_position="first").drop_duplicates("rec_id", keep="last")


def texts_of(column):
    """{text: number} and the encoded texts."""
    number = {t: k for k, t in enumerate(dict.fromkeys(t for t in column if t))}
    ids = words.new_ids()
    return number, [words.encode(t, ids) for t in number]


def near(encoded, pairs):
    pairs = [(a, b) for a, b in pairs if (encoded[a] != 0).any() and (encoded[b] != 0).any()]
    out = set()
    for at in range(0, len(pairs), 20_000):
        part = pairs[at : at + 20_000]
        sides = []
        for i in (0, 1):
            own = [encoded[p[i]] for p in part]
            sides += [np.concatenate(own), np.concatenate(([0], np.cumsum([len(x) for x in own])))]
        hit = words.near_pairs(*sides)
        same = [int(words.text_keys(encoded[a], np.array([0, len(encoded[a])]))[0][0]) == int(words.text_keys(encoded[b], np.array([0, len(encoded[b])]))[0][0]) if not h else True for (a, b), h in zip(part, hit.tolist())]
        out.update(p for p, h in zip(part, same) if h)
    return out


@pytest.mark.parametrize("limit", [neardup.SHARD_LIMIT, 20])
def test_groups_of_all_positives(spark, small, limit):
    rows = latest(spark, small)
    number, encoded = texts_of(rows["positive"])
    links = near(encoded, list(combinations(range(len(encoded)), 2)))
    root = groups.forest(links)
    by = {}
    for r, t in zip(rows["rec_id"], rows["positive"]):
        if t and (encoded[number[t]] != 0).any():
            by.setdefault(root.get(number[t], number[t]), []).append(int(r))
    want = {p for g in by.values() for p in combinations(sorted(g), 2)}
    source = neardup._positives(spark, small)
    named = neardup.group_records(source, limit).collect()
    got = {}
    for r in named:
        got.setdefault(r["grp"], []).append(r["rec_id"])
    assert {p for g in got.values() for p in combinations(sorted(g), 2)} == want and len(want) > 5
    if limit == neardup.SHARD_LIMIT:
        assert {tuple(r) for r in neardup.p4_found(spark, small).collect()} == want


def test_overlaps_of_all_records(spark, small):
    rows = latest(spark, small)
    rows = rows[rows["split"].isin(["train", "valid", "test"])]
    number, encoded = texts_of([*rows["positive"], *(t for n in rows["negatives"] if n is not None for t in n)])
    own = []
    for r, s, p, n in zip(rows["rec_id"], rows["split"], rows["positive"], rows["negatives"]):
        negatives = [number[t] for t in n if t] if n is not None else []
        own.append((int(r), s == "train", [number[p]] if p else [], negatives))
    asked = {}
    for ra, ta, pa, na in own:
        for rb, tb, pb, nb in own:
            if ta or not tb:
                continue
            for x, y in [(x, y) for x in pa for y in pb + nb] + [(x, y) for x in na for y in pb]:
                asked.setdefault((min(x, y), max(x, y)), set()).add((min(ra, rb), max(ra, rb)))
    same = {p for p in asked if p[0] == p[1] and (encoded[p[0]] != 0).any()}
    want = set().union(*(asked[p] for p in same | near(encoded, [p for p in asked if p[0] != p[1]])))
    assert {tuple(r) for r in overlap.p3_found(spark, small).collect()} == want and len(want) > 5
