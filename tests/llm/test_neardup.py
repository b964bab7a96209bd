from __future__ import annotations

import itertools
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tessella.llm import common, neardup
from tessella.llm.components import components
from tests.llm.helpers import docs_of


def shingle_set(text):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(zip(w, w[1:], w[2:])) if len(w) > 2 else frozenset([tuple(w)])


def brute(rows):
    """Expected component of every doc_id."""
    sets = {i: shingle_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 85 * len(sets[a] | sets[b]):
            up[find(a)] = find(b)
    groups = defaultdict(list)
    for i in sets:
        groups[find(i)].append(i)
    return {i: min(g) for g in groups.values() for i in g}


def edited_copies(seed, groups, size, most):
    rng = random.Random(seed)
    rows = []
    for g in range(groups):
        base = [f"w{rng.randrange(5000)}" for _ in range(150)]
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randrange(most + 1)):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    rng.shuffle(rows)
    return rows


def check(spark, rows):
    got = {r["doc_id"]: r for r in neardup.group(docs_of(spark, rows)).collect()}
    expected = brute(rows)
    assert {i: r["component_id"] for i, r in got.items()} == expected
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())
    assert {i: r["n_shingles"] for i, r in got.items()} == {i: len(shingle_set(t)) for i, t in rows}


def test_small_groups_and_odd_texts(spark):
    rows = edited_copies(1, 6, 6, 5)
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "ONE"), (n + 5, "one two"), (n + 6, "a b c"), (n + 7, "A b\tC"), (n + 8, "É b c"), (n + 9, "é b c")]
    check(spark, rows)


def test_large_group_of_near_copies_has_every_link(spark):
    # Pairwise similarities lie on both sides of the threshold; many members link to a few others only.
    check(spark, edited_copies(2, 1, 260, 9) + [(1000 + i, f"alone {i} " + " ".join(f"q{i * 50 + k}" for k in range(40))) for i in range(20)])


def test_large_group_without_a_central_text_has_every_link(spark):
    # No copy is the base: each has 2 to 4 edits, so most pairs lie below the threshold and no member links to all.
    rng = random.Random(5)
    base = [f"w{rng.randrange(5000)}" for _ in range(150)]
    rows = []
    for i in range(1100):
        copy = list(base)
        for k in rng.sample(range(150), rng.randrange(2, 5)):
            copy[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    check(spark, rows)


def test_shared_passage_makes_no_group(spark):
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(i, passage + " " + " ".join(f"z{rng.randrange(10**6)}" for _ in range(60))) for i in range(120)]
    check(spark, rows)


def test_empty_table_and_columns(spark):
    assert neardup.group(docs_of(spark, [])).count() == 0
    rows = docs_of(spark, [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d")])
    clashing = rows.selectExpr("*", "1 AS cid", "2 AS band", "3 AS key", "4 AS label", "5 AS digest")
    got = neardup.group(clashing).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (None, 1)}
    kept = neardup.keep_one(clashing)
    assert kept.columns == clashing.columns and kept.count() == 1


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    found = {r["node"]: r["label"] for r in components(links).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}
    assert components(links.limit(0)).count() == 0


def test_registers_estimate_jaccard():
    rng = np.random.default_rng(0)
    errors = []
    for share in (0.5, 0.7, 0.9):
        for _ in range(20):
            common = rng.integers(0, 2**63, 800, dtype=np.uint64)
            n = int(800 / share - 800)
            own = [np.unique(np.concatenate([common, rng.integers(0, 2**63, n // 2, dtype=np.uint64)]) * np.uint64(2)) for _ in range(2)]
            real = len(np.intersect1d(*own)) / len(np.union1d(*own))
            errors.append(np.mean(neardup.registers(own[0]) == neardup.registers(own[1])) - real)
    assert abs(np.mean(errors)) < 0.02 and np.max(np.abs(errors)) < 0.2


def test_components_of_shuffled_paths_and_real_sizes(spark):
    rng = random.Random(7)
    ids = list(range(500))
    rng.shuffle(ids)
    path = list(zip(ids, ids[1:]))
    ring = [(1000 + i, 1000 + (i * 7 + 7) % 210) for i in range(0, 210)]
    star = [(5000, 5001 + i) for i in range(300)]
    found = components(spark.createDataFrame(path + ring + star + [(9000, 9000)], "a long, b long"))
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in path + ring + star:
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert {r["node"]: r["label"] for r in found.collect()} == {n: root(n) for n in up}
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 10**8


def five_word_groups(rows):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(zip(*(w[k:] for k in range(5)))) if len(w) > 4 else frozenset([tuple(w)] if w else [])
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * len(sets[a] | sets[b]):
            up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in sets}


def test_stage_takes_five_words_and_eighty_percent(spark, sf_dir):
    import corpus_pipeline

    words = [f"u{k}" for k in range(100)]
    rows = edited_copies(4, 5, 12, 5)
    # Alike by 0.845 in shingles of three words and 0.842 in those of five: copies at 0.8 only.
    rows += [(500, " ".join(words)), (501, " ".join(words + [f"v{k}" for k in range(18)])), (502, "a b c d"), (503, "a b c d"), (504, None), (505, "")]
    docs = docs_of(spark, rows).selectExpr("*", "1 AS own", "2 AS row", "3 AS kept_key")
    stage = dict(corpus_pipeline.STAGES)["near-duplicate removal"]
    kept = stage(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    expected = five_word_groups(rows)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, c in expected.items() if i == c}
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    groups = five_word_groups([(r["doc_id"], r["text"]) for r in documents.collect()])
    assert {r["doc_id"] for r in stage(spark, documents, sf_dir).collect()} == {i for i, c in groups.items() if i == c}


def test_repeated_keys_elsewhere_do_not_change_who_stays(spark):
    rows = [(9, "x y z w"), (10, "x y z w"), (3, "other words are here"), (3, "third words are there now")]
    kept = neardup.keep_one(docs_of(spark, rows))
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, rows[2][1]), (3, rows[3][1]), (9, "x y z w")]


def test_slot_tables_miss_no_number(spark, monkeypatch):
    numbers = spark.range(3000).select(F.xxhash64("id").alias("n"))
    other = spark.range(3000, 6000).select(F.xxhash64("id").alias("n"))
    for slots in (2**26, 2**15):
        monkeypatch.setattr(common, "SLOTS", slots)
        table = common.slot_table(numbers)
        assert common.marked(numbers, "n", table, "found").where("found").count() == 3000
        shared = common.marked(other, "n", table, "found").where("found").count()
        assert shared < 10 if slots == 2**26 else 0 < shared < 600
    none = common.slot_table(numbers.limit(0))
    assert common.marked(numbers, "n", none, "found").where("found").count() == 0


def test_survivors_where_all_rows_share_slots(spark, monkeypatch):
    rows = [(i, f"{i % 40} " + " ".join(f"w{i % 40}x{j}" for j in range(60))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = list(range(40))
    assert sorted(r[0] for r in neardup.keep_one(docs).select("doc_id").collect()) == want
    monkeypatch.setattr(common, "SLOTS", 1)
    assert sorted(r[0] for r in neardup.keep_one(docs).select("doc_id").collect()) == want
