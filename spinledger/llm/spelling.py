"""Spelling variants: words that differ by one letter, found by walking tries as tables.

The words of each length form a trie of their own, once read forwards and once backwards.
Its edges are a distributed table. A frontier of states (word, position, node, edits)
starts at the node that the word's own first half leads to and moves down level by level:
each level is one join of all states with the edges of that level. A state with an edit
left takes the edge of its own letters or one with a foreign letter, and then has none
left; states at the end of a trie with their edit spent are neighbours.

Two words one edit apart share a half before or behind the edit, so starting at the half
in both directions misses none and no state walks through the crowded top of a trie. A
word looks for its longer and its equally long neighbours; the shorter ones come by
symmetry. An edge spans several letters, so that even very long words take a fixed number
of levels, and an edge with a foreign letter also spans the next own one, so that few
states enter a dead end. Nodes and edges are named by 64-bit hashes; a last comparison of
the two words drops what a collision might add.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinledger.llm.common import materialize

SHORTEST = 7
LEAST_COUNT = 2
DAMAGE = 31
FACTOR = 10
#: A word's second half takes at most this many levels.
LEVELS = 8
#: Distinct words that a task counts before it hands them on.
COUNTED = 200_000

_RUN = re.compile("[a-zÀ-ÿ]+")


def _counts_of(shortest: int, damage: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        run = re.compile(_RUN.pattern.replace("+", f"{{{shortest},}}"))

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for part in parts:
            for doc, text in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True):
                if not text:
                    continue
                found = Counter(run.findall(text.encode().lower().decode()))  # bytes: only A-Z change
                if damage is None:
                    total.update(found)
                else:
                    head = f"{doc or ''}:".encode()
                    start = crc32(head)
                    for word, n in found.items():
                        h = crc32(word.encode(), start)
                        if h % damage == 0:
                            i = h % len(word)
                            word = word[:i] + word[i + 1 :]
                        total[word] += n
                if len(total) > COUNTED:
                    yield rows()
        yield rows()

    return count


def count_words(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST_COUNT, damage: int | None = None) -> DataFrame:
    """(word, n): runs of Latin letters with ``A-Z`` lowered, of at least ``shortest`` letters and ``least`` occurrences.

    With ``damage``, a run whose crc32 of ``<doc_id>:<run>`` is a multiple of it first
    loses the letter at that number modulo its length, which makes variants to find. A
    null text has no word; a null id counts as an empty one.
    """
    source = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    counted = source.mapInArrow(_counts_of(shortest, damage), "word string, n bigint")
    return (
        counted.groupBy("word").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) & (F.length("word") >= shortest))
    )


# The trie of words of ``size`` letters in direction ``back``: depth of its first nodes, letters an edge spans.
# A state or an edge of level ``at`` starts at depth ``d``; with the edit spent it is one letter deeper.
_GRID = {
    "top": "cast(if(back = 0, ceil(size / 2), floor(size / 2)) as int)",
    "step": f"greatest(2, cast(ceil((size - top) / {LEVELS}) as int))",
}


def _grid(df: DataFrame) -> DataFrame:
    return df.withColumn("top", F.expr(_GRID["top"])).withColumn("step", F.expr(_GRID["step"]))


def _node(text: str, depth: str) -> str:
    """A node is its trie and its prefix; the end of a word is the word itself, read forwards."""
    return f"if({depth} >= size, xxhash64({text}), xxhash64(back, size, left({text}, {depth})))"


def _edge(parent: str, kind: str, before: str, behind: str) -> str:
    return f"xxhash64({parent}, {kind}, {before}, {behind})"


def edges(words: DataFrame) -> DataFrame:
    """(at, key, letter, child): all trie edges; ``key`` names parent, kind of edge and letters.

    Kinds: -1 own letters only, -2 the same with the edit spent, and from 0 on the place
    of a foreign ``letter`` within the edge.
    """
    tries = _grid(
        words.select("word", F.length("word").alias("size"), F.explode(F.array(F.lit(0), F.lit(1))).alias("back")).withColumn(
            "s", F.when(F.col("back") == 0, F.col("word")).otherwise(F.reverse("word"))
        )
    )
    levels = tries.select("*", F.explode(F.expr("sequence(0, cast(ceil((size - top) / step) as int) - 1)")).alias("at"))
    levels = levels.withColumn("d", F.expr("top + at * step")).withColumn("here", F.expr("xxhash64(back, size, left(s, d))"))
    # a word's end has one name in both directions
    ends = {"plain": "least(d + step, size)", "edit": "least(d + step + 1, size)"}
    child = lambda depth: _node("s", depth).replace("xxhash64(s)", "xxhash64(word)")
    own = levels.filter("d + step < size").select(
        "at", F.expr(_edge("here", "-1", "substring(s, d + 1, step)", "''")).alias("key"), F.lit("").alias("letter"), F.expr(child("d + step")).alias("child")
    )
    spent = levels.filter("at > 0 and d + 1 < size").select(
        "at",
        F.expr(_edge("xxhash64(back, size, left(s, d + 1))", "-2", f"substring(s, d + 2, {ends['edit']} - d - 1)", "''")).alias("key"),
        F.lit("").alias("letter"),
        F.expr(child(ends["edit"])).alias("child"),
    )
    foreign = levels.select("*", F.explode(F.expr("sequence(0, least(step, size - d) - 1)")).alias("j")).select(
        "at",
        F.expr(_edge("here", "j", "substring(s, d + 1, j)", f"substring(s, d + j + 2, {ends['edit']} - d - j - 1)")).alias("key"),
        F.expr("substring(s, d + j + 1, 1)").alias("letter"),
        F.expr(child(ends["edit"])).alias("child"),
    )
    return own.union(spent).union(foreign).distinct()


def _start(words: DataFrame) -> DataFrame:
    """Each word at the half of the tries of its own length and of one letter more, both ways."""
    first = words.select(
        "word",
        F.explode(F.array(*[F.struct(F.lit(b).alias("back"), F.lit(m).alias("more")) for b in (0, 1) for m in (0, 1)])).alias("t"),
    ).select("word", "t.back", "t.more", (F.length("word") + F.col("t.more")).cast("int").alias("size"))
    placed = _grid(first).withColumn("s", F.when(F.col("back") == 0, F.col("word")).otherwise(F.reverse("word")))
    node = F.expr("xxhash64(back, size, left(s, top))")
    return placed.select("word", "back", "more", F.col("top").alias("position"), node.alias("node"), F.lit(0).alias("edits"))


def _probes(states: DataFrame, at: int) -> DataFrame:
    """The edges each state may take on level ``at``; ``not_letter`` is the word's own letter where a foreign one goes.

    A replacement is looked for from the smaller letter only.
    """
    own = _grid(states.withColumn("size", F.expr("cast(length(word) + more as int)"))).withColumn(
        "s", F.when(F.col("back") == 0, F.col("word")).otherwise(F.reverse("word"))
    )
    own = own.withColumn("d", F.expr(f"top + {at} * step"))
    end = "least(d + step + 1, size)"
    fresh, spent = own.filter("edits = 0"), own.filter("edits = 1")
    keep = ["word", "back", "more"]
    none = F.lit("").alias("not_letter")
    moves = fresh.filter("d + step < size").select(
        *keep, F.lit(0).alias("edits"), F.expr("d + step").alias("position"), F.expr(_edge("node", "-1", "substring(s, d + 1, step)", "''")).alias("key"), none
    )
    edit = fresh.select("*", F.explode(F.expr("sequence(0, least(step, size - d) - 1)")).alias("j")).select(
        *keep,
        F.lit(1).alias("edits"),
        F.expr(f"{end} - more").alias("position"),
        F.expr(
            _edge("node", "j", "substring(s, d + 1, j)", f"substring(s, d + j + 2 - more, {end} - d - j - 1)")
        ).alias("key"),
        F.expr("substring(s, d + j + 1, 1)").alias("not_letter"),
    )
    rest = spent.select(
        *keep,
        F.lit(1).alias("edits"),
        F.expr(f"{end} - more").alias("position"),
        F.expr(_edge("node", "-2", f"substring(s, position + 1, {end} - d - 1)", "''")).alias("key"),
        none,
    )
    return moves.union(edit).union(rest)


def neighbour_pairs(words: DataFrame) -> DataFrame:
    """(a, b) once for each two words of ``words`` (word, unique) that differ by exactly one inserted, deleted or replaced letter."""
    longest = words.agg(F.max(F.length("word"))).first()[0] or 0
    tries = materialize(edges(words), "edges", "at")
    states, ends = _start(words), []
    for at in range(min(LEVELS, -(-longest // 4) + 1)):
        level = tries.filter(F.col("at") == at).drop("at")
        moved = (
            _probes(states, at)
            .join(level, "key")
            .filter("letter <> not_letter and (more = 1 or letter > not_letter) or letter = '' and not_letter = ''")
            .select("word", "back", "more", "position", F.col("child").alias("node"), "edits")
        )
        reached = materialize(moved, "frontier")
        done = F.expr("edits = 1 and position = length(word)")
        ends.append(reached.filter(done).select("word", "node"))
        states = reached.filter(~done)
    if not ends:
        return words.select(F.col("word").alias("a"), F.col("word").alias("b")).limit(0)
    found = ends[0]
    for part in ends[1:]:
        found = found.union(part)
    named = words.select(F.col("word").alias("b"), F.xxhash64("word").alias("node"))
    pairs = found.join(named, "node").select(F.col("word").alias("a"), "b")
    return pairs.filter(F.levenshtein("a", "b") == 1).distinct()


def roots(steps: DataFrame) -> DataFrame:
    """(word, root) for ``steps`` (word, form) without cycles, following forms to the last one by doubling the steps."""
    state = materialize(steps.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = state.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = state.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        after = materialize(moved, "roots")
        state = after.drop("moved")
        if after.filter("moved").isEmpty():
            return state


def group_variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for ``words`` (word, n).

    A word's near words differ from it by one letter. Its form is the most frequent of
    them, the smallest in code-point order among equals, if ``factor`` times as frequent
    as the word itself; otherwise null. ``root`` follows the forms to the last one.
    Repeated words in ``words`` count as one with the largest ``n``; null and empty ones
    are left out. An empty table gives an empty one.
    """
    own = materialize(words.filter("word is not null and word <> ''").groupBy("word").agg(F.max("n").cast("bigint").alias("n")), "words")
    pairs = materialize(neighbour_pairs(own.select("word")), "pairs")
    both = pairs.union(pairs.select("b", "a"))
    best: Column = F.min(F.struct((-F.col("n")).alias("minus"), F.col("b").alias("form")))
    near = (
        both.join(own.select(F.col("word").alias("b"), "n"), "b")
        .groupBy("a")
        .agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
        .select(F.col("a").alias("word"), "n_near", (-F.col("best.minus")).alias("form_n"), F.col("best.form").alias("form"))
    )
    formed = own.join(near, "word", "left")
    frequent = F.col("form_n") >= factor * F.col("n")
    formed = materialize(
        formed.select(
            "word",
            F.when(frequent, F.col("form")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(frequent, F.col("form_n")).alias("form_n"),
        ),
        "formed",
    )
    last = roots(formed.filter("form is not null"))
    return formed.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def spelling_variants(docs: DataFrame) -> DataFrame:
    """:func:`group_variants` of the words of ``docs`` (doc_id, text) with their planned damage."""
    return group_variants(count_words(docs, damage=DAMAGE))
