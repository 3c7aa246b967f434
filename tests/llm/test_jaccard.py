"""The n-gram Jaccard join against all pairs."""

import random
import re

import numpy as np
import pytest

from spinledger.llm import jaccard
from spinledger.llm.components import components

SCHEMA = "doc_id bigint, text string, node string, rep int, component string"


def naive_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def naive_components(rows):
    sets = [(i, naive_set(t)) for i, t in rows if i is not None]
    part = {i: i for i, _ in sets}

    def root(i):
        while part[i] != i:
            i = part[i]
        return i

    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                low, high = sorted((root(a), root(b)))
                part[high] = low
    return {i: root(i) for i in part}


def corpus(seed):
    made = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = made.choices(vocabulary, k=60)
    rows = []
    for size in (3, 5, 7, 12, 25, 60, 150, 400):
        base = made.choices(vocabulary, k=size)
        for _ in range(9):
            words = list(base)
            for _ in range(made.randint(0, max(1, size // 25))):
                at = made.randrange(len(words))
                words[at : at + made.randint(0, 1)] = made.choices(vocabulary, k=made.randint(0, 2))
            rows.append(words)
    rows += [passage + made.choices(vocabulary, k=made.randint(0, 60)) for _ in range(40)]
    rows += [made.choices(["aa", "bb"], k=made.randint(1, 14)) for _ in range(40)]
    rows += [base[:] for _ in range(8)]
    made.shuffle(rows)
    return [(i, made.choice([" ", "\n", "\t "]).join(made.choice([w, w.upper()]) for w in words)) for i, words in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_all_pairs(spark, seed):
    rows = corpus(seed) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "É a b c d e"), (1004, "é a b c d e")]
    docs = spark.createDataFrame([(i, t, "n", 1, "c") for i, t in rows], SCHEMA)
    result = jaccard.jaccard_components(docs)
    assert result.columns == ["doc_id", "n_shingles", "component_id"]
    found, expected = {r.doc_id: r for r in result.collect()}, naive_components(rows)
    assert {i: r.component_id for i, r in found.items()} == expected
    assert all(found[i].n_shingles == len(naive_set(t)) for i, t in rows)
    assert 20 < len(set(expected.values())) < len(rows) - 40


def test_repeated_and_null_ids(spark):
    text = "one two three four five six seven"
    rows = [(None, text), (1, text), (1, text), (2, text), (3, "other words that are here alone"), (3, text), (4, "other words that are here alone")]
    docs = spark.createDataFrame([(i, t, "n", 1, "c") for i, t in rows], SCHEMA)
    found = sorted((r.doc_id or 0, r.component_id or 0) for r in jaccard.jaccard_components(docs).collect())
    assert found == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 1), (3, 1), (4, 1)]
    assert jaccard.jaccard_components(docs.limit(0)).count() == 0


def test_similar_sets_always_share_what_is_needed():
    made, bands = np.random.default_rng(4), jaccard.Bands(75)
    for trial in range(600):
        size = int(made.integers(1, 400))
        common = made.integers(0, 2**63, size).astype(np.uint64)
        both = round(size / 3)
        a, b = int(made.integers(0, both + 1)), 0
        b = both - a
        x = np.unique(np.concatenate((common, made.integers(0, 2**63, a).astype(np.uint64))))
        y = np.unique(np.concatenate((common, made.integers(0, 2**63, b).astype(np.uint64))))
        same = len(np.intersect1d(x, y))
        if 100 * same < 75 * (len(x) + len(y) - same):
            continue
        of = [{bands.of(len(s)) + step: (needed, set(found.tolist())) for step, needed, found in jaccard.signatures(s, bands)} for s in (x, y)]
        band = max(bands.of(len(x)), bands.of(len(y)))
        shared = len(of[0][band][1] & of[1][band][1])
        assert shared >= max(of[0][band][0], of[1][band][0]) >= 1


def test_bands_hold_partners_of_neighbours():
    bands = jaccard.Bands(75)
    for size in range(1, 3000):
        assert bands.of(bands.partner(size)) - bands.of(size) in (0, 1)
        assert bands.largest(bands.of(size)) >= size


def test_components_of_a_long_path_and_a_star(spark):
    made = random.Random(6)
    nodes = made.sample(range(10_000), 200)
    links = list(zip(nodes, nodes[1:])) + [(20_000, k) for k in range(30_000, 30_100)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {**{n: min(nodes) for n in nodes}, **{k: 20_000 for k in [20_000, *range(30_000, 30_100)]}}
