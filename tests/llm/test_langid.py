"""Language identification: sums over segmentations, learning and edge cases."""

import zlib
from itertools import product

import numpy as np
import public_tokenizers
import pytest

from spinledger.llm import langid

VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id bigint, text string, lang string, source string, score string, held_out string"


def segmentations(word):
    for cuts in product([False, True], repeat=len(word) - 1):
        parts, start = [], 0
        for k, cut in enumerate(cuts, 1):
            if cut:
                parts.append(word[start:k])
                start = k
        yield [*parts, word[start:]]


@pytest.fixture(scope="module")
def pieces():
    return langid.pieces_of(VOCABULARY)


def test_forward_sums_every_segmentation(pieces):
    made = np.random.default_rng(3)
    table = langid.full_table(made.dirichlet(np.ones(len(pieces.names)), 2).T)
    number = {p: i for i, p in enumerate(pieces.names)}
    for word in ["the", "über", "x中", "contention"]:
        for lang in (0, 1):
            total = 0
            for parts in segmentations("▁" + word):
                chance = 1.0
                for part in parts:
                    row = number.get(part, pieces.unknown if len(part) == 1 else pieces.none)
                    chance *= table[row, lang]
                total += chance
            assert np.isclose(np.exp(langid.word_scores([word], pieces, table)[0, lang]), total)


def test_expected_counts_match_enumeration(pieces):
    made = np.random.default_rng(4)
    table = langid.full_table(made.dirichlet(np.ones(len(pieces.names)), 2).T)
    number = {p: i for i, p in enumerate(pieces.names)}
    found = langid.expected_counts(["then", "on"], np.array([0, 1]), np.array([2.0, 1.0]), pieces, table)
    expected = np.zeros_like(found)
    for word, lang, n in (("then", 0, 2), ("on", 1, 1)):
        weighted = []
        for parts in segmentations("▁" + word):
            rows = [number.get(p, pieces.unknown if len(p) == 1 else pieces.none) for p in parts]
            weighted.append((float(np.prod(table[rows, lang])), rows))
        whole = sum(w for w, _ in weighted)
        for w, rows in weighted:
            for row in rows:
                expected[row, lang] += n * w / whole
    assert np.allclose(found[: len(pieces.names)], expected[: len(pieces.names)])


def test_held_out_documents_are_named_and_mostly_right(spark):
    english, german = "the of and tion that with have ing her".split(), "der und schein keit ich nicht ung ver ein".split()
    made, rows = np.random.default_rng(5), []
    for i in range(300):
        words = made.choice(english if i % 2 else german, 12)
        rows.append((i, " ".join(words), "en" if i % 2 else "de", "s", None, None))
    docs = spark.createDataFrame(rows, SCHEMA)
    result = langid.identify(docs, VOCABULARY)
    assert result.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = {r.doc_id: r for r in result.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    out = [r for r in found.values() if r.held_out]
    assert len(out) > 40 and np.mean([r.lang_pred == ("en" if r.doc_id % 2 else "de") for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_labels_of_held_out_documents_are_not_learned(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "the of and", "xx" if i in held else "en", "s", None, None) for i in range(200)]
    languages, _ = langid.train(spark.createDataFrame(rows, SCHEMA), VOCABULARY)
    assert languages == ["en"]


def test_edges(spark):
    rows = [(1, "the and of", "en"), (3, "der und die", "de"), (4, None, "en"), (6, "123 ... ²", "en"), (7, "", None), (8, "x" * 5000, None), (None, "the and", None), (9, "the", "en"), (9, "the", "en")]
    docs = spark.createDataFrame([(*r, "s", None, None) for r in rows], SCHEMA)
    found = langid.identify(docs, VOCABULARY).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(rows) and all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (4, 6, 7))
    assert by_id[None].lang_pred == "en" and by_id[8].lang_pred in ("en", "de")
    nothing = langid.identify(docs.filter("lang is null"), VOCABULARY).collect()
    assert {r.lang_pred for r in nothing} == {"und"}
    assert langid.identify(docs.limit(0), VOCABULARY).count() == 0


def test_texts_in_no_learned_language_are_rejected(spark):
    english, german = "the of and tion that with have ing her".split(), "der und schein keit ich nicht ung ver ein".split()
    made = np.random.default_rng(6)
    rows = [(i, " ".join(made.choice(english if i % 2 else german, 12)), "en" if i % 2 else "de") for i in range(200)]
    foreign = [
        "Η γρήγορη καφέ αλεπού πηδάει πάνω από το τεμπέλικο σκυλί",
        "الثعلب البني السريع يقفز فوق الكلب الكسول ويركض في الغابة",
        "तेज भूरी लोमड़ी आलसी कुत्ते के ऊपर कूदती है",
        "Szybki brązowy lis przeskakuje nad leniwym psem i biegnie przez ciemny las",
        "xkqz vbnrt plkmj qwrtz ghjkl zxcvb nmtrw",
        "敏捷的棕色狐狸跳过了懒惰的狗 然后跑进森林",
    ]
    rows += [(1000 + i, text, None) for i, text in enumerate(foreign)]
    docs = spark.createDataFrame([(*r, "s", None, None) for r in rows], SCHEMA)
    told = {r.doc_id: r for r in langid.identify(docs, VOCABULARY).collect()}
    assert any(told[1000 + i].score >= 0.5 for i in range(len(foreign)))  # the posterior alone would keep them
    assert {r.doc_id for r in langid.keep_identified(docs, VOCABULARY).collect()} == set(range(200))
