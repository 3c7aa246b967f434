"""Repair of damaged conversations: the cheapest edits that give well-formed turns.

A conversation's role initials must read ``(s?(ua)+)?``. Rows are kept, given another
role, deleted, or empty ones are inserted; a dynamic programme over a graph of (row, what
came last) finds the cheapest edits. Each path's weight is one big integer: its high
digits are the cost, and below them stands one digit for each edit, at a fixed place,
with zeros behind the last. The least integer is the cheapest path and, among equals,
the one whose letters come first; nothing but integer minima decides.

A conversation can be any share of the table. The rows are sorted by conversation and
turn over all tasks and cut into slices of bounded size. A conversation within one slice
is repaired in place. Of the others each slice gives the best edits from every state to
every state; these are put together first by task, then by conversation, as letters
and without texts, and every slice then applies its own. Two paths of equal cost to the
same state never are one the beginning of the other, so least parts make the least whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spinledger.llm.common import materialize

SLICE_ROWS = 512
SLICE_CHARS = 1 << 20
RETYPE, REMOVE, ADD = 2, 3, 2

# What came last: nothing, system, user, assistant; an end is well-formed after nothing or an assistant.
_STATES = range(4)
_KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Where an inserted or retyped row leads: a user, or behind a user an assistant.
_GIVEN = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
#: Inserted rows that end a conversation in each state.
_END = ("", "II", "I", "")
_LETTERS = "0DIKR"
_ORDER = str.maketrans("1234", _LETTERS[1:])
_WHITE = " \t\n\x0b\x0c\r"


class Row(NamedTuple):
    initial: str
    gone: bool
    """Blank or repeated: has to be deleted."""
    cut: bool
    """Ends in the middle of a sentence: one more if it stays."""


Best = tuple[int, str]


def best_edits(rows: list[Row], begin: int) -> dict[int, Best]:
    """Least (cost, letters) from state ``begin`` over ``rows`` to each state that can be reached."""
    places = 3 * len(rows)  # one letter for each row and at most two inserted before it
    unit = 1 << 3 * places
    at = [1 << 3 * (places - 1 - i) for i in range(places)]
    reached = {begin: (0, 0)}  # state: weight, letters so far

    def offer(into: dict[int, tuple[int, int]], state: int, weight: int, n: int) -> None:
        if state not in into or weight < into[state][0]:
            into[state] = (weight, n)

    for row in rows:
        for _ in range(2):
            for state, (weight, n) in list(reached.items()):
                if n + 1 < places:
                    offer(reached, _GIVEN[state], weight + ADD * unit + 2 * at[n], n + 1)
        after: dict[int, tuple[int, int]] = {}
        extra = unit if row.cut else 0
        for state, (weight, n) in reached.items():
            offer(after, state, weight + REMOVE * unit + at[n], n + 1)
            if not row.gone:
                if row.initial in _KEEP[state]:
                    offer(after, _KEEP[state][row.initial], weight + extra + 3 * at[n], n + 1)
                offer(after, _GIVEN[state], weight + extra + RETYPE * unit + 4 * at[n], n + 1)
        reached = after
    return {
        state: (weight >> 3 * places, format(weight & unit - 1, f"0{places}o").rstrip("0").translate(_ORDER) if places else "")
        for state, (weight, _) in reached.items()
    }


def _ended(best: dict[int, Best]) -> tuple[int, int, str]:
    """Least cost, letters and last state of a whole conversation, closing rows included."""
    cost, letters, state = min((c + ADD * len(_END[s]), letters + _END[s], s) for s, (c, letters) in best.items())
    return cost, state, letters


def apply_edits(rows: list[tuple[object, str, str]], letters: str, begin: int) -> list[tuple[str, object, str, str]]:
    """(edit, turn, role, text) in order: every row of ``rows`` (turn, role, text) under its letter, and inserted ones."""
    out, state, i = [], begin, 0
    for letter in letters:
        if letter == "I":
            state = _GIVEN[state]
            out.append(("I", None, _ROLE[state], ""))
            continue
        turn, role, text = rows[i]
        i += 1
        if letter == "R":
            state = _GIVEN[state]
            role = _ROLE[state]
        elif letter == "K":
            state = _KEEP[state][role[:1]]
        out.append((letter, turn, role, text))
    return out


def fault(text: str, repeated: bool) -> str | None:
    """The first fault of a row: ``blank``, ``duplicate`` or ``truncated``."""
    body = text.rstrip(_WHITE)
    return "blank" if not body else "duplicate" if repeated else None if body[-1] in ".!?" else "truncated"


def damage(rows: DataFrame) -> DataFrame:
    """The planned damage of ``rows`` (conv_id, turn, role, text): some are lost, emptied, cut, repeated or get another role.

    Nulls count as one space, in the number that decides too; ``conv_id`` and ``turn`` stay null.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    text, role = name("text"), name("role")
    luck = F.crc32(F.encode(F.concat(name("conv_id"), F.lit(":"), name("turn")), "UTF-8")) % 20
    marked = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), luck.alias("luck")).filter("luck <> 0")
    return marked.select(
        "conv_id",
        "turn",
        F.when(F.col("luck") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("luck") == 1, "").when(F.col("luck") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("luck") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def slices(rows: DataFrame, most_rows: int = SLICE_ROWS, most_chars: int = SLICE_CHARS) -> DataFrame:
    """``rows`` (conv_id, turn, role, text without nulls) by conversation and turn, cut into slices.

    Columns: conv_id, slice (ascending along the order), run (the first slice of the
    conversation within its task), whole (the conversation is this one slice), rows.
    Turns of null come first; rows of one turn follow by role and a hash of the text.
    """
    row = T.StructType([rows.schema["turn"], rows.schema["role"], rows.schema["text"]])
    schema = T.StructType(
        [
            rows.schema["conv_id"],
            *[T.StructField(n, T.LongType()) for n in ("slice", "run")],
            T.StructField("whole", T.BooleanType()),
            T.StructField("rows", T.ArrayType(row)),
        ]
    )
    kinds = [_arrow_type(f.dataType) for f in (rows.schema["conv_id"], *row.fields)]

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 32
        number, run, own, chars = 0, 0, [], 0
        now: object = None
        first = begun = True  # the first conversation of a task may have begun in the one before
        out: list[tuple[object, int, int, bool, list]] = []

        def close(last: bool) -> None:
            nonlocal number, own, chars
            out.append((now, base + number, base + run, last and not first and number == run, own))
            number, own, chars = number + 1, [], 0

        def batch() -> pa.RecordBatch:
            sizes = [0]
            for x in out:
                sizes.append(sizes[-1] + len(x[4]))
            flat = [[r[i] for x in out for r in x[4]] for i in range(3)]
            inner = pa.StructArray.from_arrays([pa.array(v, k) for v, k in zip(flat, kinds[1:], strict=True)], row.names)
            columns = [pa.array([x[0] for x in out], kinds[0]), *[pa.array([x[i] for x in out], pa.int64()) for i in (1, 2)]]
            whole = pa.array([x[3] for x in out], pa.bool_())
            out.clear()
            return pa.RecordBatch.from_arrays([*columns, whole, pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), inner)], schema.names)

        held = 0
        for part in parts:
            for conv, *values in zip(*[part.column(i).to_pylist() for i in range(4)], strict=True):
                if begun:
                    begun, now = False, conv
                elif conv != now:
                    close(True)
                    first, now, run = False, conv, number
                if len(own) >= most_rows or chars >= most_chars:
                    close(False)
                own.append(values)
                chars += len(values[2])
                held += len(values[2])
                if held >= most_chars and out:
                    held = 0
                    yield batch()
        if own:
            close(False)  # may go on in the next task
        if out:
            yield batch()

    tie = F.monotonically_increasing_id()
    ordered = (
        rows.select("conv_id", "turn", "role", "text", F.md5(F.encode("text", "UTF-8")).alias("digest"), tie.alias("tie"))
        .repartitionByRange("conv_id", "turn", "role", "digest", "tie")
        .sortWithinPartitions("conv_id", "turn", "role", "digest", "tie")
        .drop("digest", "tie")
    )
    return ordered.mapInArrow(cut, schema)


def _edits_schema(conv: T.StructField, turn: T.StructField) -> T.StructType:
    edit = T.StructType([T.StructField("edit", T.StringType()), turn, T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
    counts = [T.StructField(n, T.LongType()) for n in ("slice", "blank", "duplicate", "truncated", "illegal", "cost")]
    return T.StructType([conv, *counts, T.StructField("audit", T.StringType()), T.StructField("edits", T.ArrayType(edit))])


_PROPER = {("s", "u"), ("u", "a"), ("a", "u")}


def _judged(rows: list[tuple[object, str, str]], repeated: set[int], before: str | None) -> tuple[list[Row], list[int]]:
    """Each row for the programme, and how many are blank, duplicate, truncated or follow a role they must not.

    ``before`` is the role initial of the row in front, None where there is none.
    """
    found = [fault(text, i in repeated) for i, (_, _, text) in enumerate(rows)]
    initials = [role[:1] for _, role, _ in rows]
    fronts = [before, *initials[:-1]]
    illegal = sum(a is not None and (a, b) not in _PROPER for a, b in zip(fronts, initials, strict=True))
    made = [Row(i, f in ("blank", "duplicate"), f == "truncated") for i, f in zip(initials, found, strict=True)]
    return made, [*[found.count(f) for f in ("blank", "duplicate", "truncated")], illegal]


def _repair_with(schema: T.StructType, plan: Callable[[dict], tuple[list[int], int, str, list]]) -> Callable:
    arrow = pa.schema([pa.field(f.name, _arrow_type(f.dataType)) for f in schema.fields])
    edit = arrow.field("edits").type.value_type

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for i in range(0, part.num_rows, 64):
                rows = part.slice(i, 64).to_pylist()
                done = [plan(r) for r in rows]
                sizes = [0]
                for _, _, _, edits in done:
                    sizes.append(sizes[-1] + len(edits))
                flat = [[e[k] for *_, edits in done for e in edits] for k in range(4)]
                inner = pa.StructArray.from_arrays([pa.array(v, edit.field(k).type) for k, v in enumerate(flat)], [edit.field(k).name for k in range(4)])
                columns = [
                    pa.array([r["conv_id"] for r in rows], arrow.field("conv_id").type),
                    pa.array([r["slice"] for r in rows], pa.int64()),
                    *[pa.array([d[0][k] for d in done], pa.int64()) for k in range(4)],
                    pa.array([d[1] for d in done], pa.int64()),
                    pa.array([d[2] for d in done], pa.string()),
                    pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), inner),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return run


def _triples(row: dict) -> list[tuple[object, str, str]]:
    return [(r["turn"], r["role"], r["text"]) for r in row["rows"]]


def _plan_whole(row: dict) -> tuple[list[int], int, str, list]:
    rows = _triples(row)
    seen: set[tuple[str, str]] = set()
    repeated = set()
    for i, (_, role, text) in enumerate(rows):
        if (role, text) in seen:
            repeated.add(i)
        seen.add((role, text))
    judged, counts = _judged(rows, repeated, None)
    cost, _, letters = _ended(best_edits(judged, 0))
    return counts, cost, letters, apply_edits(rows, letters, 0)


def _plan_part(row: dict) -> tuple[list[int], int, str, list]:
    rows = _triples(row)
    _, counts = _judged(rows, set(row["later"] or ()), row["before"])
    return counts, row["cost"], row["audit"], apply_edits(rows, row["audit"], row["entry"])


def _ranks(letters: list[str | None]) -> list[int]:
    """For each state to begin in, the order of the letters to each state to end in."""
    out = []
    for s in _STATES:
        own = letters[4 * s : 4 * s + 4]
        order = sorted(x for x in own if x is not None)
        out += [-1 if x is None else order.index(x) for x in own]
    return out


def _moves_of(conv: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["conv_id", "run", "slice", "first", "last", "costs", "ranks", "letters"]
    numbers, words = pa.list_(pa.int32()), pa.list_(pa.string())
    kinds = [conv, pa.int64(), pa.int64(), pa.string(), pa.string(), numbers, numbers, words]

    def moves(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out: list[tuple] = []
            for row in part.to_pylist():
                later = set(row["later"] or ())
                rows = [Row(c["initial"], c["blank"] or i in later, c["open"]) for i, c in enumerate(row["codes"])]
                found: list[Best | None] = []
                for s in _STATES:
                    best = best_edits(rows, s)
                    found += [best.get(t) for t in _STATES]
                letters = [f and f[1] for f in found]
                costs = [-1 if f is None else f[0] for f in found]
                out.append((row["conv_id"], row["run"], row["slice"], rows[0].initial, rows[-1].initial, costs, _ranks(letters), letters))
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return moves


class Way(NamedTuple):
    cost: int
    rank: int
    """Place of its letters among the ways to all states."""
    states: tuple | None
    """States that its parts begin in, linked from the last to the first."""


def join_ways(parts: list[tuple[list[int], list[int]]], begin: int) -> dict[int, Way]:
    """Least ways through parts in a row, given each part's costs and ranks from every state to every state."""
    best = {begin: Way(0, 0, None)}
    for costs, ranks in parts:
        after: dict[int, tuple[int, int, int, tuple]] = {}
        for s, way in best.items():
            for t in _STATES:
                if costs[4 * s + t] >= 0:
                    mine = (int(way.cost + costs[4 * s + t]), way.rank, int(ranks[4 * s + t]))
                    if t not in after or mine < after[t][:3]:
                        after[t] = (*mine, (s, way.states))
        order = sorted(after, key=lambda t: after[t][1:3])
        best = {t: Way(after[t][0], order.index(t), after[t][3]) for t in order}
    return best


def _unlinked(states: tuple | None) -> list[int]:
    out = []
    while states is not None:
        out.append(states[0])
        states = states[1]
    return out[::-1]


def _parts_of(group: pd.DataFrame) -> list[tuple[list[int], list[int]]]:
    return list(zip(group["costs"].tolist(), group["ranks"].tolist(), strict=True))


def _join_run(group: pd.DataFrame) -> pd.DataFrame:
    """One row for the slices of one conversation in one task, in the form that its slices have."""
    group = group.sort_values("slice")
    ways = [join_ways(_parts_of(group), s) for s in _STATES]
    each = [ways[s].get(t) for s in _STATES for t in _STATES]
    out = group[["conv_id", "run", "first"]].iloc[:1].copy()
    out["last"] = group["last"].iloc[-1]
    out["costs"] = [[-1 if w is None else w.cost for w in each]]
    out["ranks"] = [[-1 if w is None else w.rank for w in each]]
    return out


def _join_conversation(group: pd.DataFrame) -> pd.DataFrame:
    """Where each task's part of a conversation begins and ends on the best way."""
    group = group.sort_values("run")
    ways = join_ways(_parts_of(group), 0)
    end = min(ways, key=lambda t: (ways[t].cost + ADD * len(_END[t]), ways[t].rank))
    begins = _unlinked(ways[end].states)
    return pd.DataFrame(
        {
            "run": group["run"].to_numpy(),
            "entry": begins,
            "leave": [*begins[1:], end],
            "before": pd.Series([None, *group["last"].tolist()[:-1]], dtype=object),
            "closing": pd.Series([""] * (len(group) - 1) + [_END[end]], dtype=object),
        }
    )


def _assign(group: pd.DataFrame) -> pd.DataFrame:
    """State to begin in, cost and letters of each slice of a run."""
    group = group.sort_values("slice")
    entry, leave = int(group["entry"].iloc[0]), int(group["leave"].iloc[0])
    begins = _unlinked(join_ways(_parts_of(group), entry)[leave].states)
    ends = [*begins[1:], leave]
    steps = [4 * s + t for s, t in zip(begins, ends, strict=True)]
    closing = [""] * (len(group) - 1) + [group["closing"].iloc[0]]
    return pd.DataFrame(
        {
            "slice": group["slice"].to_numpy(),
            "entry": begins,
            "before": pd.Series([group["before"].iloc[0], *group["last"].tolist()[:-1]], dtype=object),
            "cost": [int(c[k]) + ADD * len(x) for c, k, x in zip(group["costs"], steps, closing, strict=True)],
            "audit": pd.Series([w[k] + x for w, k, x in zip(group["letters"], steps, closing, strict=True)], dtype=object),
        }
    )


def _later(parts: DataFrame) -> DataFrame:
    """(slice, later): places of the rows whose role and text stood earlier in the conversation."""
    named = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    head = F.concat(F.col("conv_id").isNull().cast("string"), F.length(named).cast("string"), F.lit(":"), named)
    placed = parts.select("conv_id", "slice", F.posexplode("rows").alias("at", "r"))
    marked = placed.select(
        "slice",
        "at",
        F.md5(F.encode(F.concat(head, F.length("r.role").cast("string"), F.lit(":"), F.col("r.role"), F.col("r.text")), "UTF-8")).alias("digest"),
    )
    place = F.struct("slice", "at")
    first = marked.groupBy("digest").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").drop("last")
    later = marked.join(first, "digest").filter(place > F.col("first"))
    return later.groupBy("slice").agg(F.collect_list("at").alias("later"))  # at most the rows of one slice


def repair(rows: DataFrame, most_rows: int = SLICE_ROWS, most_chars: int = SLICE_CHARS) -> tuple[DataFrame, DataFrame]:
    """Cheapest repairs of ``rows`` (conv_id, turn, role, text): of whole conversations, and of slices of the others.

    Both tables have one row for each slice: conv_id, slice (ascending within a
    conversation), its numbers of blank, duplicate and truncated rows and of illegal role
    changes, cost, audit (the letters of its edits) and edits (edit, turn, role, text) in
    order, deleted rows included. A kept or deleted row is as it was. Other columns are
    left out. A null role or text counts as one space; null turns come first, a null id
    is a conversation of its own, repeated rows are duplicates. A slice holds at most
    ``most_rows`` rows and, but for one text longer than that, ``most_chars`` characters.
    An empty table gives empty ones.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    cut = materialize(slices(rows.select("conv_id", "turn", space("role"), space("text")), most_rows, most_chars), "slices")
    schema = _edits_schema(rows.schema["conv_id"], rows.schema["turn"])
    alone = cut.filter("whole").mapInArrow(_repair_with(schema, _plan_whole), schema)

    parts = cut.filter("not whole")
    codes = F.transform(
        "rows",
        lambda r: F.struct(
            F.left(r["role"], F.lit(1)).alias("initial"),
            (~r["text"].rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
            (~r["text"].rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"),
        ),
    )
    later = materialize(_later(parts), "later")
    kind = rows.schema["conv_id"]
    head = T.StructType([kind, T.StructField("run", T.LongType())])
    ends = [T.StructField(n, T.StringType()) for n in ("first", "last")]
    tables = [T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("costs", "ranks")]
    moves = materialize(
        parts.select("conv_id", "run", "slice", codes.alias("codes"))
        .join(later, "slice", "left")
        .select("conv_id", "run", "slice", "codes", "later")
        .mapInArrow(
            _moves_of(_arrow_type(kind.dataType)),
            T.StructType([*head, T.StructField("slice", T.LongType()), *ends, *tables, T.StructField("letters", T.ArrayType(T.StringType()))]),
        ),
        "moves",
    )
    runs = moves.drop("letters").groupBy("conv_id", "run").applyInPandas(_join_run, T.StructType([*head, *ends, *tables]))
    ways = runs.groupBy("conv_id").applyInPandas(_join_conversation, "run bigint, entry int, leave int, before string, closing string")
    given = moves.drop("conv_id").join(ways, "run").groupBy("run").applyInPandas(_assign, "slice bigint, entry int, before string, cost bigint, audit string")
    planned = parts.join(given, "slice").join(later, "slice", "left")
    return alone, planned.mapInArrow(_repair_with(schema, _plan_part), schema)


def repaired_rows(edits: DataFrame) -> DataFrame:
    """(conv_id, slice, at, edit, turn, role, text): the rows that stay, in order, of a table that :func:`repair` gave."""
    each = edits.select("conv_id", "slice", F.posexplode("edits").alias("at", "e"))
    return each.select("conv_id", "slice", "at", "e.*").filter("edit <> 'D'")


def _lines(edits: Column) -> Column:
    stays = F.filter(edits, lambda e: e["edit"] != "D")
    return F.transform(stays, lambda e: F.concat(e["role"], F.lit(":"), e["text"]))


_DIGEST = ("blank", "duplicate", "truncated", "illegal", "cost")


def _stream_digests(conv: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts, letters and digest of conversations whose slices arrive in order; one slice's lines at a time are held."""
    names = ["conv_id", *_DIGEST, "audit", "repaired_sha256"]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = None
        state: tuple[list[int], list[str], object, bool] | None = None

        def row() -> pa.RecordBatch:
            sums, letters, digest, _ = state
            values = [now, *sums, "".join(letters), digest.hexdigest()]
            kinds = [conv, *[pa.int64()] * 5, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)

        for part in parts:
            for i in range(part.num_rows):
                x = part.slice(i, 1).to_pylist()[0]
                if state is None or x["conv_id"] != now:
                    if state is not None:
                        yield row()
                    now, state = x["conv_id"], ([0] * 5, [], hashlib.sha256(), False)
                sums, letters, digest, begun = state
                for k, name in enumerate(_DIGEST):
                    sums[k] += x[name]
                letters.append(x["audit"])
                if x["lines"]:
                    digest.update(("\n" if begun else "").encode() + "\n".join(x["lines"]).encode())
                    state = (sums, letters, digest, True)
        if state is not None:
            yield row()

    return run


def repair_digests(rows: DataFrame, most_rows: int = SLICE_ROWS) -> DataFrame:
    """Damage ``rows`` as planned, repair them, and one row for each conversation of ``rows``.

    conv_id, gaps (missing turns between the least and the largest after the damage),
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. A digest runs over
    all of a conversation's text, so one task streams the slices of a long one.
    """
    damaged = damage(rows)
    alone, parts = repair(damaged, most_rows)
    lines = _lines(F.col("edits"))
    sha = F.sha2(F.encode(F.array_join(lines, "\n"), "UTF-8"), 256).alias("repaired_sha256")
    single = alone.select("conv_id", *_DIGEST, "audit", sha)
    schema = T.StructType([rows.schema["conv_id"], *[T.StructField(n, T.LongType()) for n in _DIGEST], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    streamed = (
        parts.select("conv_id", "slice", *_DIGEST, "audit", lines.alias("lines"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "slice")
        .mapInArrow(_stream_digests(_arrow_type(rows.schema["conv_id"].dataType)), schema)
    )
    found = single.union(streamed).withColumnRenamed("conv_id", "own")
    turns = damaged.groupBy("conv_id", "turn").agg(F.lit(1).alias("one")).groupBy("conv_id")
    gaps = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("bigint").alias("gaps")).withColumnRenamed("conv_id", "other")
    every = rows.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("own")), "left").join(gaps, F.col("conv_id").eqNullSafe(F.col("other")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select(
        "conv_id",
        zero("gaps"),
        *[zero(c) for c in _DIGEST],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
