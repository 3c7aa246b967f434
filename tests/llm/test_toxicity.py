"""Toxicity: the models' probabilities against plain counting, held-out labels, edge cases."""

import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from spinledger.llm import toxicity as tx

SCHEMA = "doc_id bigint, text string, toxic string, score string, held_out int"
CALM = ["river", "stone", "garden", "letter", "window", "Tuesday", "of", "the", "under", "morning"]
RUDE = ["numbskull", "blockhead", "nitwit"]


def texts_of(seed, n):
    made, rows = random.Random(seed), []
    for i in range(n):
        words = [made.choice(CALM) + made.choice(["", "", "s"]) for _ in range(made.randint(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(made.randint(1, 4)):
                words.insert(made.randrange(len(words)), made.choice(RUDE))
        rows.append((i, " ".join(words) + ".", toxic))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame([(i, 1, int(x)) for i, _, x in rows], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_held_out_documents(spark):
    rows = texts_of(1, 600)
    docs, labels = tables(spark, rows)
    result = tx.score_documents(docs, labels)
    assert result.columns == ["doc_id", "held_out", "score", "predicted"]
    found = {r.doc_id: r for r in result.collect()}
    held = [i for i, _, _ in rows if crc32(str(i).encode()) % 5 == 0]
    assert len(found) == 600 and {i for i, r in found.items() if r.held_out} == set(held)
    right = sum(found[i].predicted == rows[i][2] for i in held)
    assert right >= 0.97 * len(held) and all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in found.values())


def test_held_out_labels_are_not_read(spark):
    rows = texts_of(2, 300)
    turned = [(i, t, x != (crc32(str(i).encode()) % 5 == 0)) for i, t, x in rows]
    assert turned != rows
    scores = [sorted(map(tuple, tx.score_documents(*tables(spark, r)).collect())) for r in (rows, turned)]
    assert scores[0] == scores[1]


def test_probabilities_follow_plain_counts(spark):
    rows = texts_of(3, 400)
    frame = spark.createDataFrame([(t, x) for _, t, x in rows], "text string, toxic boolean")
    model = tx.fit_models(frame, 1 << 20, 1 << 20)
    counts = {True: Counter(), False: Counter()}
    for _, text, toxic in rows:
        words = tx._WORD.findall(text.lower())
        counts[toxic].update(zip(["", *words], words, strict=False))
    both = counts[True] + counts[False]
    often = {p: n for p, n in both.items() if n >= tx.FREQUENT}
    assert often and len(often) < len(both)

    def probability(toxic, before, word):
        own = counts[toxic]
        around = Counter(w for _, w in own)
        off = {w: min(n, tx.DISCOUNT) for w, n in around.items()}
        shared = (sum(w == word for _, w in both) + 2**-20) / (len(both) + 1)
        low = (around[word] - off.get(word, 0) + max(1, sum(off.values())) * shared) / len(own)
        behind = {p: n for p, n in often.items() if p[0] == before}
        total = sum(behind.values())
        weight = total / (sum(n for p, n in both.items() if p[0] == before) + tx.FREQUENT)
        high = 0
        if (before, word) in behind:
            expected = tx.SHARED * behind[before, word] / total
            high = weight * (own[before, word] + expected) / (sum(own[p] for p in behind) + tx.SHARED)
        return high + (1 - weight) * low

    pairs = [*random.Random(4).sample(sorted(both), 40), ("of", "unheard"), ("unheard", "numbskull")]
    number = lambda w: crc32(w.encode()) if w else 0
    found = model.evidence(np.array([number(v) for v, _ in pairs]), np.array([number(w) for _, w in pairs]))
    expected = [math.log(probability(True, *p) / probability(False, *p)) for p in pairs]
    assert np.allclose(found, expected, atol=1e-3)


def test_features_see_whole_texts():
    model = tx.Model(np.full((2, 4), 0.5), np.ones(4), np.zeros((2, 4)), np.full(4, -1), (0, 1, 1), 0.25)
    ids = tx._Ids()
    mild = ids["mild"] & 3
    model.words[0, mild] = 0.25
    long = "mild " * 100_000 + "rude rude"
    rude = ids["rude"] & 3
    assert rude != mild
    model.words[0, rude] = 1.0
    found = model.features([None, "mild", long, "", "rude", "1 2 3"], ids)
    assert np.isnan(found[[0, 3, 5]]).all()
    assert np.allclose(found[[1, 4]], [[-math.log(2)] * 2, [math.log(2)] * 2])
    assert found[2, 0] < -0.69 and math.isclose(found[2, 1], math.log(2), rel_tol=1e-6)
    assert list(model.scores(found)[[0, 3, 5]]) == [0.25] * 3


@pytest.mark.parametrize("toxic", [None, 0, 1])
def test_without_two_classes(spark, toxic):
    docs = spark.createDataFrame([(1, "a b", "x", "y", 1), (None, None, "x", "y", 1), (1, "", "x", "y", 1)], SCHEMA)
    labels = spark.createDataFrame([(1, toxic)] if toxic is not None else [], "doc_id bigint, toxic int")
    found = tx.score_documents(docs, labels).collect()
    assert len(found) == 3 and {(r.score, r.predicted) for r in found} == {(float(toxic or 0), toxic or 0)}
    assert {r.held_out for r in found if r.doc_id is None} == {True}
    assert tx.score_documents(docs.limit(0), labels).count() == 0


def test_repeated_rows_and_labels(spark):
    rows = texts_of(5, 200)
    docs, labels = tables(spark, [*rows, rows[0], rows[1]])
    both = labels.union(spark.createDataFrame([(1, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int"))
    found = tx.score_documents(docs, both).collect()
    assert len(found) == 202 and len({tuple(r) for r in found if r.doc_id == 0}) == 1


def test_pairs_that_share_a_slot_keep_their_own_probabilities(spark):
    rows = texts_of(6, 400)
    frame = spark.createDataFrame([(t, x) for _, t, x in rows], "text string, toxic boolean")
    wide, narrow = tx.fit_models(frame, 1 << 16, 1 << 20), tx.fit_models(frame, 1 << 16, 1)
    assert len(narrow.rest_keys) > 10 and not len(wide.rest_keys)
    ids = tx._Ids()
    texts = [t for _, t, _ in rows]
    assert np.array_equal(wide.features(texts, ids), narrow.features(texts, ids))


@pytest.mark.parametrize("slots,held", [(1, 1 << 20), (2, 0)])
def test_scores_do_not_depend_on_slots_of_pairs(spark, slots, held):
    rows = [*texts_of(7, 300), (1000, None, False), (1001, "", True)]
    found = [sorted(map(tuple, tx.score_documents(*tables(spark, rows), 1 << 16, *by).collect())) for by in ((1 << 20,), (slots, held))]
    assert found[0] == found[1] and len(found[0]) == 302
