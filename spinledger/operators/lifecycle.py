"""Review and dispute decisions over detections, and the reviewer's views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinledger.functions.columns import is_blank
from spinledger.functions.lineage import cut
from spinledger.schemas import DISPUTE_REASONS

MAX_NOTE = 2_000
# Who may do what.
REVIEW_ROLES = ("reviewer", "catalog_admin")
RESOLUTION_ROLES = ("finance_reviewer", "catalog_admin")

# A detection's state is its status and whether a dispute is open.
STATUSES = ("candidate", "verified", "rejected", "disputed", "expired")
STATES = [(status, opened) for status in STATUSES for opened in (False, True)]
ACTIONS = ("verify", "reject", "open", "uphold", "dismiss")


def _next_state(action: str, status: str, opened: bool) -> tuple[str, bool]:
    """The state after ``action``; the same state when the action is refused."""
    if action in ("verify", "reject") and status == "candidate":
        return ("verified" if action == "verify" else "rejected"), opened
    if action == "open" and status in ("candidate", "verified") and not opened:
        return "disputed", True
    if action in ("uphold", "dismiss") and opened:
        return ("rejected" if action == "uphold" else "verified"), False
    return status, opened


def _moves() -> Column:
    """For each action, the next state of each state: a table of 5 by 10 numbers."""
    rows = [
        F.array(*[F.lit(STATES.index(_next_state(a, *state))) for state in STATES]) for a in ACTIONS
    ]
    return F.array(*rows)


def command_errors() -> Column:
    """The stateless refusal of a command, or NULL: role, then value, then note."""
    kind, value, role = F.col("command"), F.col("value"), F.col("role")
    length = F.length(F.trim("note"))
    shortest = F.when(kind == "open", 20).otherwise(10)
    role_ok = (
        F.when(kind == "decide", role.isin(*REVIEW_ROLES))
        .when(kind == "resolve", role.isin(*RESOLUTION_ROLES))
        .otherwise(F.lit(True))
    )
    value_ok = (
        F.when(kind == "decide", value.isin("verified", "rejected"))
        .when(kind == "open", value.isin(*DISPUTE_REASONS))
        .when(kind == "resolve", value.isin("upheld", "dismissed"))
    )
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(~kind.isin("decide", "open", "resolve"), "unknown_command")
        .when(is_blank(F.col("user_id").cast("string")), "authentication_required")
        .when(no(role_ok), "forbidden")
        .when(no(value_ok), "invalid_value")
        .when(no(length >= shortest), "note_too_short")
        .when(length > MAX_NOTE, "note_too_long")
    )


def first_states(detections: DataFrame, disputes: DataFrame) -> DataFrame:
    """(detection_id, _start): the number of each detection's state before any command."""
    opened = disputes.where(F.col("status") == "open").select("detection_id").distinct().withColumn("_open", F.lit(True))
    first = F.lit(0)
    for i, (status, is_open) in enumerate(STATES):
        match = (F.col("status") == status) & (F.coalesce("_open", F.lit(False)) == F.lit(is_open))
        first = F.when(match, i).otherwise(first)
    return detections.join(opened, "detection_id", "left").select("detection_id", first.alias("_start"))


def judged_commands(commands: DataFrame) -> DataFrame:
    """``commands`` with ``_error``, the stateless refusal, and ``_action``, a number into ``ACTIONS``, where there is none."""
    action = (
        F.when(F.col("value") == "verified", 0)
        .when(F.col("value") == "rejected", 1)
        .when(F.col("command") == "open", 2)
        .when(F.col("value") == "upheld", 3)
        .when(F.col("value") == "dismissed", 4)
    )
    return commands.withColumn("_error", command_errors()).withColumn("_action", F.when(F.col("_error").isNull(), action))


def _composed(kids: Column) -> Column:
    """One state map for maps that follow one another."""
    same = F.array(*[F.lit(i) for i in range(len(STATES))])
    return F.aggregate(kids, same, lambda acc, k: F.transform(acc, lambda s: F.get(k["_map"], s)))


def _entered(kids: Column, state: Column) -> Column:
    """Each map's own place and the state it begins with, after the maps before it."""
    entry = "array<struct<_at:bigint,_start:int>>"
    return F.aggregate(
        kids,
        F.struct(state.alias("state"), F.array().cast(entry).alias("log")),
        lambda acc, k: F.struct(
            F.get(k["_map"], acc["state"]).alias("state"),
            F.concat(acc["log"], F.array(F.struct(k["_at"].alias("_at"), acc["state"].alias("_start")))).alias("log"),
        ),
    )["log"]


def _tree_states(leaves: DataFrame, start: DataFrame, fan_in: int) -> DataFrame:
    """(detection_id, _part, _slice, _start): the state in which each slice begins.

    Maps are composed upwards, ``fan_in`` neighbours at a time: the slices of a detection
    within one part, then its parts. From the detection's own first state the states go
    down the same tree.
    """
    most = leaves.agg(F.max("_slice").alias("s"), F.max("_part").alias("p")).first()
    nodes, levels = leaves.select("detection_id", "_part", F.col("_slice").alias("_at"), "_map"), []

    def up(keys: list[str]) -> None:
        nonlocal nodes
        kids = F.array_sort(F.collect_list(F.struct("_at", "_map"))).alias("_kids")  # at most fan_in
        above = nodes.groupBy(*keys, F.floor(F.col("_at") / fan_in).cast("long").alias("_up")).agg(kids)
        if levels:
            above = cut(above)
        levels.append((keys, above))
        nodes = above.select(*keys, F.col("_up").alias("_at"), _composed(F.col("_kids")).alias("_map"))

    slices, parts = most["s"] or 0, most["p"] or 0
    while slices:
        up(["detection_id", "_part"])
        slices //= fan_in
    nodes = nodes.select("detection_id", F.col("_part").cast("long").alias("_at"), "_map")
    while True:
        up(["detection_id"])
        parts //= fan_in
        if not parts:
            break
    states = nodes.join(start, "detection_id", "left").select("detection_id", "_at", "_start")
    inside = False
    for keys, above in reversed(levels):
        if "_part" in keys and not inside:  # what was a part's place becomes its name
            states, inside = states.select("detection_id", F.col("_at").alias("_part"), F.lit(0).cast("long").alias("_at"), "_start"), True
        below = above.join(states.withColumnRenamed("_at", "_up"), [*keys, "_up"])
        states = below.select(*keys, F.explode(_entered(F.col("_kids"), F.col("_start"))).alias("e")).select(*keys, "e.*")
    if not inside:
        return states.select("detection_id", F.col("_at").alias("_part"), F.lit(0).cast("long").alias("_slice"), "_start")
    return states.select("detection_id", "_part", F.col("_at").alias("_slice"), "_start")


def apply_commands(
    detections: DataFrame, disputes: DataFrame, commands: DataFrame, fan_in: int = 256
) -> DataFrame:
    """Every command with ``accepted``, ``reason`` and the detection's ``status_after``.

    Commands of a detection apply in ``seq`` order, a number unique over all commands.
    A command maps each of ten states to a state, and such maps compose. All commands are
    sorted over the tasks, so a detection with many of them spreads over several parts;
    within a part each ``fan_in`` of its commands are a slice, counted, however their
    numbers lie. A tree of composed maps gives every slice its first state, and the
    slices replay independently. No row holds more than ``fan_in`` commands or maps.
    """
    judged = judged_commands(commands)
    moves = _moves()
    spread = (
        judged.where(F.col("detection_id").isNotNull())
        .select("detection_id", "seq", "_action", "_error")
        .repartitionByRange("detection_id", "seq")
        .withColumn("_part", F.spark_partition_id().cast("long"))
    )
    counted = F.row_number().over(Window.partitionBy("detection_id", "_part").orderBy("seq")) - 1
    one_map = F.aggregate(
        F.filter("_items", lambda x: x["_action"].isNotNull()),
        F.array(*[F.lit(i) for i in range(len(STATES))]),
        lambda acc, x: F.transform(acc, lambda s: F.get(F.get(F.col("_moves"), x["_action"]), s)),
    )
    slices = cut(
        spread.withColumn("_slice", F.floor(counted / fan_in).cast("long"))
        .groupBy("detection_id", "_part", "_slice")
        .agg(F.array_sort(F.collect_list(F.struct("seq", "_action", "_error"))).alias("_items"))
        .withColumn("_moves", moves)
        .withColumn("_map", one_map)
        .drop("_moves")
    )
    states = _tree_states(slices, first_states(detections, disputes), fan_in)
    result = "struct<seq:bigint,error:string,action:int,before:int,after:int>"

    def step(acc: Column, x: Column) -> Column:
        now = acc["state"]
        after = F.coalesce(F.get(F.get(F.col("_moves"), x["_action"]), now), now)
        row = F.struct(
            x["seq"].cast("bigint").alias("seq"),
            x["_error"].alias("error"),
            x["_action"].alias("action"),
            now.alias("before"),
            after.alias("after"),
        )
        return F.struct(after.alias("state"), F.concat(acc["log"], F.array(row)).alias("log"))

    replayed = slices.withColumn("_moves", moves).join(states, ["detection_id", "_part", "_slice"]).select(
        "detection_id",
        F.explode(
            F.aggregate(
                "_items",
                F.struct(F.col("_start").alias("state"), F.array().cast(f"array<{result}>").alias("log")),
                step,
            )["log"]
        ).alias("r"),
    )
    nowhere = judged.where(F.col("detection_id").isNull()).select(
        "detection_id",
        F.struct(
            F.col("seq").cast("bigint").alias("seq"), F.col("_error").alias("error"), F.col("_action").alias("action"),
            F.lit(None).cast("int").alias("before"), F.lit(None).cast("int").alias("after"),
        ).alias("r"),
    )
    names = F.array(*[F.lit(status) for status, _ in STATES])
    refused = (
        F.when(F.col("r.error").isNotNull(), F.col("r.error"))
        .when(F.col("r.before").isNull(), "not_found")
        .when(F.col("r.after") != F.col("r.before"), None)
        .when(F.col("r.action").isin(3, 4), "no_open_dispute")
        .when((F.col("r.action") == 2) & (F.col("r.before") % 2 == 1), "dispute_already_open")
        .otherwise("state_conflict")
    )
    return replayed.unionByName(nowhere).select(
        "detection_id",
        F.col("r.seq").alias("seq"),
        refused.isNull().alias("accepted"),
        refused.alias("reason"),
        F.get(names, F.col("r.after")).alias("status_after"),
        (F.col("r.after") % 2 == 1).alias("dispute_open_after"),
    )


def next_outcome(state: int | None, action: int | None, error: str | None) -> tuple[int | None, str | None]:
    """The state after one judged command, and why it is refused, or None."""
    if error is not None:
        return state, error
    if state is None:
        return None, "not_found"
    after = STATES.index(_next_state(ACTIONS[action], *STATES[state]))
    if after != state:
        return after, None
    if ACTIONS[action] in ("uphold", "dismiss"):
        return state, "no_open_dispute"
    return state, "dispute_already_open" if ACTIONS[action] == "open" and STATES[state][1] else "state_conflict"


def latest_status(detections: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Each detection's status after its last accepted command."""
    last = (
        outcomes.where("accepted")
        .groupBy("detection_id")
        .agg(F.max_by("status_after", "seq").alias("_last"))
    )
    return (
        detections.join(last, "detection_id", "left")
        .withColumn("status", F.coalesce("_last", "status"))
        .drop("_last")
    )


def status_counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy("status").agg(F.count(F.lit(1)).alias("detections"))


def time_to_resolve(disputes: DataFrame) -> DataFrame:
    """Dispute counts and mean hours to resolution per status."""
    hours = (F.unix_micros("resolved_at") - F.unix_micros("created_at")) / F.lit(3.6e9)
    return disputes.groupBy("status").agg(
        F.count(F.lit(1)).alias("disputes"), F.round(F.avg(hours), 4).alias("mean_hours")
    )


def with_dispute(detections: DataFrame, disputes: DataFrame) -> DataFrame:
    """Flag detections with an open dispute; there is at most one."""
    opened = disputes.where(F.col("status") == "open").select(
        "detection_id", F.lit("open").alias("dispute_status")
    ).distinct()
    return detections.join(opened, "detection_id", "left").withColumn(
        "has_dispute", F.col("dispute_status").isNotNull()
    )


def evidence_view(detections: DataFrame) -> DataFrame:
    """The redacted, nested row a reviewer may see. Columns not named here never leave."""
    return detections.select(
        F.col("detection_id").alias("id"),
        "capture_chunk_id",
        F.struct(F.col("source_id").alias("id"), F.col("source_code").alias("code")).alias("source"),
        "recording_id",
        "started_at",
        "ended_at",
        F.round(F.col("duration_seconds").cast("double"), 3).alias("duration_seconds"),
        F.struct(
            "matcher_version",
            "fingerprint_schema_id",
            "matched_hash_count",
            F.round(F.col("match_confidence").cast("double"), 4).alias("match_confidence"),
            "tempo_scale",
            F.round(F.col("offset_seconds").cast("double"), 3).alias("offset_seconds"),
        ).alias("evidence"),
        "status",
        "reviewed_by",
        "reviewed_at",
        "review_note",
        F.struct(F.col("has_dispute").alias("open"), F.col("dispute_status").alias("status")).alias("dispute"),
    )


def review_queue(
    detections: DataFrame,
    *,
    status: str | None = None,
    source_code: str | None = None,
    recording_id: object = None,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """A page of the queue, newest first, with the total number of rows behind it."""
    if limit < 1 or offset < 0:
        raise ValueError("limit must be positive and offset must not be negative")
    rows = detections
    for name, wanted in (("status", status), ("source_code", source_code), ("recording_id", recording_id)):
        if wanted is not None:
            rows = rows.where(F.col(name) == F.lit(wanted))
    total = rows.agg(F.count(F.lit(1))).scalar()
    page = rows.orderBy(F.desc("started_at"), F.asc("detection_id")).offset(offset).limit(limit)
    return page.withColumn("total", total)


def list_disputes(disputes: DataFrame, *, status: str | None = None, limit: int = 50) -> DataFrame:
    if limit < 1:
        raise ValueError("limit must be positive")
    rows = disputes if status is None else disputes.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), F.asc("dispute_id")).limit(limit)


def command_audit(outcomes: DataFrame, commands: DataFrame) -> DataFrame:
    """One audit row per accepted command."""
    done = outcomes.where("accepted").join(commands, ["detection_id", "seq"])
    action = (
        F.when(F.col("command") == "decide", F.concat(F.lit("detection."), F.col("value")))
        .when(F.col("command") == "open", "dispute.opened")
        .otherwise(F.concat(F.lit("dispute."), F.col("value")))
    )
    return done.select(
        action.alias("action"),
        F.when(F.col("command") == "decide", "detection_event").otherwise("dispute").alias("entity_type"),
        F.col("detection_id").cast("string").alias("entity_id"),
        F.col("user_id").cast("string").alias("actor_id"),
        F.to_json(F.struct("note", F.col("status_after").alias("resulting_status"))).alias("metadata"),
    )
