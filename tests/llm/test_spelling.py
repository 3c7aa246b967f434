"""Spelling variants against all pairs of words."""

import random
import re
from collections import Counter
from zlib import crc32

from spinledger.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n string, form int"


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_force(rows):
    counts = Counter()
    for doc, text in rows:
        lowered = (text or "").encode().lower().decode()
        for run in re.findall("[a-zÀ-ÿ]+", lowered):
            h = crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    beside = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for word, others in beside.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[word] = best if best is not None and words[best] >= 10 * words[word] else None
    out = set()
    for word, n in words.items():
        root = word
        while form[root] is not None:
            root = form[root]
        out.add((word, form[word], root, n, len(beside[word]), words.get(form[word])))
    return out


def found(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)
    result = spelling.spelling_variants(docs)
    assert result.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows = [tuple(r) for r in result.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_variants_match_brute_force(spark):
    made = random.Random(11)
    base = ["".join(made.choice("abé×") for _ in range(made.randint(6, 12))) for _ in range(25)]

    def changed(word):
        i, letter = made.randrange(len(word)), made.choice("AbBÉéz")
        return made.choice([word, word, word[:i] + word[i + 1 :], word[:i] + letter + word[i:], word[:i] + letter + word[i + 1 :]])

    rows = [(i, " ".join(changed(made.choice(base[: 1 + i % 25])) for _ in range(60))) for i in range(150)]
    rows += [(None, "aaaaaaab aaaaaaab"), (7, None), (8, ""), (9, "1 2, 3"), (10, "bbbbbbba-bbbbbbba"), (10, "bbbbbbba-bbbbbbba")]
    expected = brute_force(rows)
    assert len(expected) > 100 and any(r[1] for r in expected)
    assert found(spark, rows) == expected


def test_forms_are_followed_to_the_root(spark):
    words = spark.createDataFrame(
        [("aaaaaaa", 1), ("aaaaaab", 10), ("aaaaabb", 100), ("aaaabbb", 1000), ("aaabbbb", 10_000), ("aaabbbb", 3), (None, 5), ("", 5)],
        "word string, n bigint",
    )
    rows = {r.word: r for r in spelling.group_variants(words).collect()}
    assert len(rows) == 5 and all(r.root == "aaabbbb" for r in rows.values())
    assert rows["aaaaaab"].form == "aaaaabb" and rows["aaaaaab"].n_near == 2 and rows["aaabbbb"].form is None
    ties = spark.createDataFrame([("abcdefg", 1), ("abcdefz", 50), ("abcdefh", 50)], "word string, n bigint")
    assert {r.word: r.form for r in spelling.group_variants(ties).collect()}["abcdefg"] == "abcdefh"


def test_very_long_words_take_few_levels(spark):
    made, words = random.Random(2), set()
    for base in ("x" * 40, "ab" * 300, "q" * 5000):
        words.add(base)
        for _ in range(5):
            i = made.randrange(len(base))
            words |= {base[:i] + base[i + 1 :], base[:i] + "z" + base[i:], base[:i] + "y" + base[i + 1 :]}
    words = sorted(words)
    expected = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if near(a, b)}
    pairs = [tuple(sorted(r)) for r in spelling.neighbour_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == expected


def test_no_words(spark):
    assert found(spark, []) == set() and found(spark, [(1, "short words only"), (2, "onceonly")]) == set()
