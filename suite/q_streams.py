"""Streams over the events file, run to completion, and the report readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinledger.functions.lineage import shared_folder
from spinledger.operators.ops import outbox_backlog
from spinledger.operators.segmentation import play_events, valid_windows
from spinledger.sources import readers, sinks
from spinledger.streaming import jobs
from suite.projections import TEXT_SCHEMA, Tables
from suite.q_lifecycle import WALK
from suite.registry import query


# The walk of q_lifecycle in the order in which the stream's three deliveries arrive.
ARRIVING = WALK.replace("order by seq) as n", "order by seq % 3, seq) as n")


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the cluster's shared checkpoint area."""
    return f"{shared_folder(spark)}/streams-{uuid.uuid4().hex}"


class StreamTables(Tables):
    """The same projections with the events read as a file stream."""

    def raw(self, name: str) -> DataFrame:
        if name != "events":
            return super().raw(name)
        schema = super().raw(name).schema
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/[e]vents.parquet")


def streamed(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.folder)


@query(
    "stream_routed_manifests",
    "select case when event_id % 26 > 12 then 'valid' else 'rejected' end as route, count(*) as n from events group by 1",
)
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    jobs.route_manifests(streamed(t).manifests, f"{path}/valid", f"{path}/rejected", f"{path}/cp").awaitTermination()
    count = lambda name: t.spark.read.parquet(f"{path}/{name}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("route"), "n")
    return count("valid").unionByName(count("rejected"))


@query(
    "stream_receipts",
    "select event_id * 3 as byte_count, cast(user_id % 30 as varchar) as source_id from events where event_id % 26 > 12 and user_id % 30 < 25",
)
def _(t: Tables) -> DataFrame:
    """Received once although the stream is delivered twice."""
    path = scratch(t.spark)
    sources = t.sources.withColumn("source_id", F.col("source_id").cast("string"))
    for checkpoint in ("first", "again"):
        jobs.receive_once(streamed(t).manifests, sources, path, TEXT_SCHEMA, f"{path}/{checkpoint}").awaitTermination()
    return t.spark.read.parquet(f"{path}/receipts").select("byte_count", "source_id")


@query(
    "stream_session_clusters",
    """select session_id, track_id, min(epoch_us(ts)) as started_us, max(epoch_us(ts) + (20 + event_id % 37) * 1000000) as ended_us, count(*) as evidence_windows from (
      select *, sum(case when reach is null or epoch_us(ts) - reach > 600000000 then 1 else 0 end) over (partition by session_id, track_id order by ts, event_id) as cluster from (
       select event_id, ts, user_id % 5 as session_id, event_type as track_id, max(epoch_us(ts) + (20 + event_id % 37) * 1000000) over (partition by user_id % 5, event_type order by ts, event_id rows between unbounded preceding and 1 preceding) as reach from events))
     group by session_id, track_id, cluster""",
)
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    start = F.col("ts").cast("timestamp")
    windows = streamed(t).raw("events").select(
        (F.col("user_id") % 5).alias("session_id"), F.col("event_type").alias("track_id"), start.alias("window_start"),
        (start + F.expr("interval 1 second") * (20 + F.col("event_id") % 37)).alias("window_end"),
    )
    clusters = jobs.session_clusters(windows, 600.0)

    def save(batch: DataFrame, _number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/clusters")

    clusters.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{path}/cp").trigger(
        availableNow=True
    ).start().awaitTermination()
    return t.spark.read.parquet(f"{path}/clusters").select(
        "session_id", "track_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), "evidence_windows"
    )


@query(
    "stream_single_use_requests",
    "select event_id from events where event_id % 10 <> 4",
)
def _(t: Tables) -> DataFrame:
    """Every eleventh request arrives twice; a tenth arrive after the five-minute window."""
    path = scratch(t.spark)
    e = F.col("event_id")
    rows = streamed(t).raw("events").select(
        e, F.concat(F.lit("device-"), F.col("user_id").cast("string")).alias("device_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.sha2(e.cast("string"), 256).alias("body_sha256"),
        F.explode(F.when(e % 11 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    late = F.when(e % 10 == 4, F.expr("interval 301 seconds")).otherwise(F.expr("interval 300 seconds"))
    rows = rows.withColumn("received_at", F.col("ts") + late)
    once = jobs.single_use(rows)
    once.writeStream.format("parquet").option("path", f"{path}/used").option("checkpointLocation", f"{path}/cp").trigger(
        availableNow=True
    ).start().awaitTermination()
    return t.spark.read.parquet(f"{path}/used").select("event_id")


@query(
    "stream_source_counts",
    "select case when event_id % 26 = 2 then '  ' else 'NATION_' || (user_id % 30) end as source_code, count(*) as chunks, sum(case when event_id % 26 = 7 then -1 else event_id * 3 end)::bigint as bytes from events group by 1",
)
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark)

    def save(batch: DataFrame, _number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/counts")

    jobs.source_counts(streamed(t).manifests).writeStream.outputMode("complete").foreachBatch(save).option(
        "checkpointLocation", f"{path}/cp"
    ).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.parquet(f"{path}/counts")


@query(
    "stream_backlog",
    """select source_id, coalesce(sum(byte_count) filter (status <> 'uploaded'), 0)::bigint as queued_bytes, count(*) filter (status in ('pending', 'retry')) as pending_count from outbox group by 1""",
)
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark)

    def save(batch: DataFrame, _number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/backlog")

    backlog = outbox_backlog(streamed(t).outbox, F.lit("2024-01-20").cast("timestamp"))
    backlog.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", f"{path}/cp").trigger(
        availableNow=True
    ).start().awaitTermination()
    return t.spark.read.parquet(f"{path}/backlog").select("source_id", "queued_bytes", "pending_count")


@query(
    "stream_commands",
    f"select * from ({ARRIVING} select detection_id, seq, cast(accepted as int) as accepted, reason, status as status_after from walk where n > 0)",
)
def _(t: Tables) -> DataFrame:
    """Commands come in three deliveries, each with smaller numbers than some before; the query restarts for each."""
    path = scratch(t.spark)
    text = lambda df: df.withColumn("detection_id", F.col("detection_id").cast("string"))
    commands = text(t.commands)
    for delivery in range(3):
        commands.where(F.col("seq") % 3 == delivery).write.mode("append").parquet(f"{path}/commands")
        arriving = t.spark.readStream.schema(commands.schema).parquet(f"{path}/commands")
        jobs.apply_command_stream(arriving, text(t.detections), text(t.disputes), f"{path}/outcomes", f"{path}/cp").awaitTermination()
    return t.spark.read.parquet(f"{path}/outcomes").select(
        F.col("detection_id").cast("bigint").alias("detection_id"), "seq", F.col("accepted").cast("int").alias("accepted"), "reason", "status_after"
    )


# Readers: the tables are written as the pilot's JSON documents and read back. ---------


@query(
    "read_station_logs",
    """select 'S' || (user_id % 25) as source_code, epoch_us(ts) // 1000000 as aired, case when event_id % 3 = 0 then '' else 'T' || event_id end as title, cast(event_id % 4 <> 1 as int) as known
     from events where event_type in ('view', 'error')""",
)
def _(t: Tables) -> DataFrame:
    path, e = scratch(t.spark), F.col("event_id")
    entry = F.struct(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("aired_at"), F.when(e % 3 != 0, F.concat(F.lit("T"), e.cast("string"))).alias("title"),
        F.when(e % 4 == 0, True).when(e % 4 == 1, False).alias("known_catalog"),
    )
    # One document per source and day keeps each document small.
    days = t.raw("events").where("event_type in ('view', 'error')").groupBy(
        F.concat(F.lit("S"), (F.col("user_id") % 25).cast("string")).alias("s"), F.to_date("ts").alias("d")
    ).agg(F.collect_list(entry).alias("entries"))
    days.select(F.to_json(F.create_map("s", "entries")).alias("value")).write.text(f"{path}/logs", lineSep="\n")
    lines = t.spark.read.text(f"{path}/logs")
    logs = readers.parse_station_logs(lines)
    return logs.select("source_code", F.expr("unix_micros(aired_at) div 1000000").alias("aired"), "title", F.col("known_catalog").cast("int").alias("known"))


@query(
    "read_manifests",
    "select case when event_id % 26 = 7 then -1 else event_id * 3 end as byte_count, count(*) as n from events group by 1",
)
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    t.manifests.write.json(f"{path}/manifests")
    again = readers.read_manifests(t.spark, f"{path}/manifests", multiLine="false")
    return again.groupBy("byte_count").agg(F.count(F.lit(1)).alias("n"))


@query(
    "read_match_windows",
    "select session_id, count(*) as n, sum(e)::bigint as total from windows group by 1",
)
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    t.windows.drop("event_id").write.json(f"{path}/windows")
    rows = readers.read_match_windows(t.spark, f"{path}/windows", multiLine="false")
    return rows.groupBy(F.col("session_id").cast("bigint").alias("session_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("ended_at_seconds").cast("bigint").alias("total")
    )


@query(
    "read_table",
    "select source_id, count(*) as n from usage_rows where status = 'verified' group by 1",
)
def _(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    t.usage.write.parquet(f"{path}/usage")
    rows = readers.read_table(t.spark, f"{path}/usage", columns=["source_id"], where="status = 'verified'")
    return rows.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))


def written(rows: DataFrame, path: str) -> str:
    """Each JSON document of ``rows`` (name, value) as a file of its own."""
    rows.write.partitionBy("name").text(path)
    return path


@query("read_reviews", "select 'C' || event_id as edge_chunk_id, case event_id % 3 when 0 then 'verified' when 1 then 'rejected' else 'candidate' end as status from events")
def _(t: Tables) -> DataFrame:
    e = F.col("event_id")
    status = F.when(e % 3 == 0, "verified").when(e % 3 == 1, "rejected").otherwise("candidate")
    item = F.struct(F.concat(F.lit("C"), e.cast("string")), status)
    days = t.raw("events").groupBy(F.to_date("ts").alias("name")).agg(F.to_json(F.map_from_entries(F.collect_list(item))).alias("value"))
    return readers.read_reviews(t.spark, written(days, f"{scratch(t.spark)}/reviews"))


@query(
    "read_candidates",
    """select 'U' || user_id as edge_chunk_id, (row_number() over (partition by user_id order by event_id) - 1)::bigint as rank, 'R' || event_id as recording_id,
      case when event_id % 4 = 0 then 0 else event_id % 60 end as votes, case when event_id % 5 = 0 then 0.0 else (event_id % 100) / 100.0::double end as hint from events""",
)
def _(t: Tables) -> DataFrame:
    """A chunk for each user; every fourth candidate has no votes and every fifth no hint."""
    e = F.col("event_id")
    one = F.struct(
        e, F.concat(F.lit("R"), e.cast("string")).alias("recording_id"), F.when(e % 4 != 0, e % 60).alias("votes"), F.when(e % 5 != 0, e % 100 / 100).alias("confidence_hint")
    )
    lists = t.raw("events").groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("items"))
    chunk = F.struct(F.concat(F.lit("U"), F.col("user_id").cast("string")), "items")
    documents = lists.groupBy((F.col("user_id") % 8).alias("name")).agg(F.to_json(F.map_from_entries(F.collect_list(chunk))).alias("value"))
    rows = readers.read_candidates(t.spark, written(documents, f"{scratch(t.spark)}/candidates"))
    return rows.select(
        "edge_chunk_id", F.col("rank").cast("bigint").alias("rank"), "recording_id", F.col("votes").cast("bigint").alias("votes"), F.col("confidence_hint").alias("hint")
    )


@query("read_catalog", "select cast(p_partkey as varchar) as recording_id, p_name as title, p_brand as artist, case when p_partkey % 3 <> 0 then 'UG' || p_partkey end as isrc from part")
def _(t: Tables) -> DataFrame:
    key = F.col("p_partkey")
    entry = F.struct(
        key.cast("string"),
        F.struct(F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.when(key % 3 != 0, F.concat(F.lit("UG"), key.cast("string"))).alias("isrc")),
    )
    documents = t.raw("part").groupBy((key % 16).alias("name")).agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    return readers.read_catalog(t.spark, written(documents, f"{scratch(t.spark)}/catalog"))


@query(
    "written_landmarks",
    "select clip_id as track_id, hash_index, anchor_frame, ratio_bin, delta_frames, hashes as track_hashes from marks where kind = 'b'",
)
def _(t: Tables) -> DataFrame:
    path = f"{scratch(t.spark)}/index"
    sinks.write_landmarks(t.index, path)
    return t.spark.read.parquet(path).select("track_id", "hash_index", "anchor_frame", "ratio_bin", "delta_frames", "track_hashes")


@query("appended_detections", "select detection_id from candidates")
def _(t: Tables) -> DataFrame:
    """The second append holds all rows again, twice; none of them comes in."""
    path = f"{scratch(t.spark)}/detections"
    rows = t.candidates.withColumn("idempotency_key", F.sha2(F.col("detection_id").cast("string"), 256))
    sinks.append_detections(rows, path)
    sinks.append_detections(rows.unionByName(rows), path)
    return t.spark.read.parquet(path).select("detection_id")


@query("written_report", "select session_id, track_id, started_at_seconds, ended_at_seconds from play_events")
def _(t: Tables) -> DataFrame:
    path = f"{scratch(t.spark)}/report"
    plays = play_events(valid_windows(t.windows, t.sessions)).select("session_id", "track_id", "started_at_seconds", "ended_at_seconds")
    sinks.write_report({"plays": plays}, path)
    return t.spark.read.schema(plays.schema).json(f"{path}/plays")
