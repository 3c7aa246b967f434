"""Conversation repair against a search that carries whole strings."""

import hashlib
import random
import re
from zlib import crc32

import pytest

from spinledger.llm import conversations as cv

SCHEMA = "conv_id bigint, turn bigint, role string, text string, slice string, cost int, edits string"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    for conv, turn, role, text in rows:
        named = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        luck = crc32(f"{named[0]}:{named[1]}".encode()) % 20
        role, text = named[2:]
        if luck == 1:
            text = ""
        elif luck == 2:
            text = re.sub("[.!?]", "", text)
        elif luck == 4:
            role = "user"
        if luck:
            yield from [(conv, turn, role, text)] * (2 if luck == 3 else 1)


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.strip(WHITE)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows):
    """All paths by (cost, letters, repaired rows), the least for each last role."""
    paths = {"": (0, "", ())}

    def offer(into, last, path):
        if last not in into or path[:2] < into[last][:2]:
            into[last] = path

    def inserted(paths):
        for _ in range(2):
            for last, (cost, letters, kept) in list(paths.items()):
                role = "assistant" if last == "u" else "user"
                offer(paths, role[0], (cost + 2, letters + "I", (*kept, (role, ""))))

    for (_, role, text), bad in zip(rows, faults(rows), strict=True):
        inserted(paths)
        after, more = {}, bad == "truncated"
        for last, (cost, letters, kept) in paths.items():
            offer(after, last, (cost + 3, letters + "D", kept))
            if bad not in ("blank", "duplicate"):
                if (last, role[:1]) in NEXT:
                    offer(after, role[:1], (cost + more, letters + "K", (*kept, (role, text))))
                given = "assistant" if last == "u" else "user"
                offer(after, given[0], (cost + more + 2, letters + "R", (*kept, (given, text))))
        paths = after
    inserted(paths)
    return min(path for last, path in paths.items() if last in ("", "a"))


def brute_force(rows):
    out, after = {}, {}
    for row in damaged(rows):
        after.setdefault(row[0], []).append(row[1:])
    for conv in {r[0] for r in rows}:
        own = sorted(after.get(conv, []), key=lambda r: (r[0] is not None, r[0], r[1], hashlib.md5(r[2].encode()).hexdigest()))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        bad = faults(own)
        illegal = sum((a[1][:1], b[1][:1]) not in {("s", "u"), ("u", "a"), ("a", "u")} for a, b in zip(own, own[1:], strict=False))
        cost, letters, kept = cheapest(own)
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
        out[conv] = (gaps, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal, cost, letters, digest)
    return out


def made_rows(seed, conversations, longest):
    made = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "usher"]
    texts = ["Yes.", "No", " ", None, "", "What?\n", "Done! \t", "and\x0b", "same.", "same.", "é…", "x" * 300 + "."]
    rows = []
    for conv in [None, *range(conversations)]:
        for turn in range(made.randint(1, longest)):
            turn = made.choice([turn, turn, turn, turn + 2, None if made.random() < 0.1 else turn])
            rows.append((conv, turn, made.choice(roles), made.choice(texts)))
    made.shuffle(rows)
    return rows


@pytest.mark.parametrize(("most_rows", "partitions", "longest"), [(512, 3, 9), (2, 5, 40), (7, 2, 200)])
def test_repairs_match_brute_force(spark, most_rows, partitions, longest):
    rows = made_rows(partitions, 40, longest)
    expected = brute_force(rows)
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        result = cv.repair_digests(table, most_rows)
        names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
        assert result.columns == names
        found = {r[0]: tuple(r)[1:] for r in result.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.keys() == expected.keys()
    for conv, row in expected.items():
        assert found[conv] == row, conv


def test_weights_choose_the_first_letters_among_equals():
    row = cv.Row
    best = cv.best_edits([row("a", False, False)], 0)
    assert best[3] == (2, "IK") and best[2] == (2, "R") and best[0] == (3, "D")
    rows = [row("u", False, True), row("x", True, False), row("u", False, False), row("s", False, False)]
    whole = cv.best_edits(rows, 0)
    for middle in range(5):
        first = cv.best_edits(rows[:middle], 0)
        joined = {}
        for s, (cost, letters) in first.items():
            for t, (more, rest) in cv.best_edits(rows[middle:], s).items():
                joined[t] = min(joined.get(t, (99, "")), (cost + more, letters + rest))
        assert joined == whole


def test_repaired_rows_are_well_formed(spark):
    rows = made_rows(8, 30, 30)
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    alone, parts = cv.repair(table, 5)
    kept = {}
    for r in sorted(cv.repaired_rows(alone.union(parts)).collect(), key=lambda r: (r.slice, r.at)):
        kept.setdefault(r.conv_id, []).append(r.role[:1])
    assert kept and all(re.fullmatch("(s?(ua)+)?", "".join(roles)) for roles in kept.values())
    long = spark.createDataFrame([(1, 0, "user", "é" * 3_000_000, "", 1, ""), (1, 1, "assistant", "a" * 2_000_000 + ".", "", 1, "")], SCHEMA)
    sizes = [len(r.text) for r in cv.repaired_rows(cv.repair(long)[0].union(cv.repair(long)[1])).orderBy("slice", "at").collect()]
    assert sizes == [3_000_000, 2_000_001]


def test_no_conversations(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert cv.repair_digests(empty).count() == 0
    lost = next(i for i in range(1000) if crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = cv.repair_digests(spark.createDataFrame([(lost, 0, "user", "Hi.", "", 1, "")], SCHEMA)).collect()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
