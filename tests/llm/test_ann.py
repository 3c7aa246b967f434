"""The prefix forest against brute force."""

import numpy as np
import pytest

from spinledger.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, rank string, score int, vector string, shard int"


def table_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "r", 1, "v", 2) for i, v in rows], SCHEMA)


def brute(rows, k):
    out = {}
    for q, a in rows:
        if q % 20 == 0:
            scored = sorted((-float((np.float64(b) * np.float64(a)).sum()), i) for i, b in rows if i != q)
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def asked(table):
    return table.filter("vec_id % 20 = 0")


def as_lists(found):
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


def test_all_candidates_give_the_exact_result_with_ties(spark):
    made = np.random.default_rng(1)
    rows = [(i, made.integers(-2, 3, 4).astype(np.float32)) for i in range(300)]
    rows = [(i, v) for i, v in rows if v.any()]
    table = table_of(spark, rows)
    result = ann.search(table, asked(table), k=20, share=1e9, shard_rows=64, block_queries=4)
    assert result.columns == ["query_id", "rank", "vec_id", "score"]
    assert as_lists(result.collect()) == brute(rows, 20)


@pytest.mark.parametrize("scaled", [False, True])
def test_recall(spark, scaled):
    made = np.random.default_rng(2)
    vectors = made.standard_normal((4000, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    if scaled:
        vectors *= made.uniform(0.5, 1.5, (4000, 1))
    rows = [(i, v.astype(np.float32)) for i, v in enumerate(vectors)]
    table = table_of(spark, rows)
    found, exact = as_lists(ann.search(table, asked(table), shard_rows=1500).collect()), brute(rows, 20)
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in near}) for q, near in exact.items())
    assert hits >= 0.9 * 20 * len(exact)
    assert all(len(near) == 20 for near in found.values())


def test_fewer_candidates_are_looked_at(spark):
    made = np.random.default_rng(3)
    vectors = made.standard_normal((3000, 64))
    forest = ann.Forest(vectors, float(np.linalg.norm(vectors, axis=1).max()), 32, 7)
    sizes = [len(c) for c in forest.candidates(vectors[:50], 300)]
    assert max(sizes) < 1500 and all(i in set(c) for i, c in enumerate(forest.candidates(vectors[:5] , 300)))


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1, 0]), (20, None), (40, [0, 0]), (60, [float("nan"), 1]), (80, [float("inf"), 1]), (1, [None, 1]), (2, [0.5, 0.5]), (None, [1, 1]), (100, [])]
    table = table_of(spark, rows)
    assert [tuple(r) for r in ann.search(table, asked(table)).collect()] == [(0, 1, 2, 0.5)]
    assert ann.search(table.limit(0), table.limit(0)).count() == 0
    alone = table.filter("vec_id = 0")
    assert ann.search(alone, alone).count() == 0


def test_repeated_rows(spark):
    rows = [(0, [1, 0]), (0, [1, 0]), (3, [1, 0]), (3, [1, 0]), (4, [1, 0]), (5, [0.5, 2])]
    table = table_of(spark, rows)
    found = sorted((r["rank"], r.vec_id) for r in ann.search(table, asked(table), shard_rows=2).collect())
    assert found == [(1, 3), (2, 4), (3, 5)]


def test_lengths_must_agree(spark):
    table = table_of(spark, [(0, [1, 0]), (1, [1, 0, 0])])
    with pytest.raises(ValueError):
        ann.search(table, table)
