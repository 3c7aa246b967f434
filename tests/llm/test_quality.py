"""Co-training on two views: separable classes, little labelled data, edge cases."""

import numpy as np

from spinledger.llm import quality

SCHEMA = "doc_id bigint, text string, lang string, source string, score string, label int"


def good(made):
    return "\n".join(" ".join(made.choice(["the", "water", "of", "runs", "there"], 9)) + "." for _ in range(3))


def bad(made):
    return " ".join(made.choice(["BUY", "NOW", "CHEAP", "CLICK"], 20)) + "!!! $$$"


def test_scores_follow_the_labels(spark):
    made = np.random.default_rng(1)
    rows = [(i, good(made) if i % 3 else bad(made), "en", f"s{i % 4}", None, None) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300, 4)], "doc_id bigint, quality int, toxic int")
    result = quality.score_documents(docs, labels)
    assert result.columns == ["doc_id", "text_score", "meta_score", "score", "keep"]
    found = result.collect()
    assert all(r.keep == (r.doc_id % 3 > 0) for r in found) and all(0 <= r.score <= 1 for r in found)
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_the_views_teach_each_other():
    right = {0: [], 4: []}
    for seed in range(8):
        made = np.random.default_rng(seed)
        y = made.integers(0, 2, 800)
        text = made.standard_normal((800, 30)) + 1.2 * y[:, None] * (np.arange(30) < 6)
        meta = made.standard_normal((800, 10)) + 1.2 * y[:, None] * (np.arange(10) < 5)
        label = np.where(np.arange(800) < 40, y, -1)
        for rounds, found in right.items():
            score = quality.co_train(text, meta, label, np.arange(800) % 4 == 2, rounds=rounds).scores(text, meta)[2]
            found.append(np.mean((score[40:] > 0.5) == y[40:]))
    assert np.mean(right[4]) > np.mean(right[0]) + 0.02 and np.mean(right[4]) > 0.92


def test_calibration_restores_probabilities():
    made = np.random.default_rng(3)
    odds = made.standard_normal(20000) * 2
    y = (made.random(20000) < quality.sigmoid(3 * odds - 1)).astype(np.int64)
    a, b = quality.calibration(odds, y)
    assert abs(a - 3) < 0.2 and abs(b + 1) < 0.15


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, 1), (2, "", "en", "s", None, 1), (None, "x", "en", None, None, 1), (3, "a b", "en", "s", None, 1), (3, "a b", "en", "s", None, 1)], SCHEMA)
    none = spark.createDataFrame([(None, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    found = quality.score_documents(docs, none).collect()
    assert len(found) == 5 and all(r.score == 0.5 and r.keep for r in found)
    one = spark.createDataFrame([(3, 0, 0), (3, 0, 0), (9, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert not any(r.keep for r in quality.score_documents(docs, one).collect())
    two = spark.createDataFrame([(3, 0, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert len(quality.score_documents(docs, two).collect()) == 5
    assert quality.score_documents(docs.limit(0), two).count() == 0
