"""Candidates against station logs, scorecards and precision slices.

Candidates: ``source_code, detection_id, recording_id, title, artist, started_at,
ended_at, votes, confidence_hint, tempo_scale, status``. Logs: ``source_code,
log_index, aired_at, title, artist, recording_id, isrc, known_catalog``. Catalog:
``recording_id, title, artist, isrc``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spinledger.functions.columns import is_blank, midpoint, ratio, title_artist_key
from spinledger.functions.skew import salted_lookup

TOLERANCE_SECONDS = 90.0
REVIEW_STATES = ("candidate", "verified", "rejected", "disputed")


def agreed_only(chunks: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks of agreed sources, warnings for the others)."""
    agreed = sources.where("agreed").select("source_code")
    spread = ["edge_chunk_id"]
    kept = salted_lookup(chunks, agreed, ["source_code"], spread_by=spread, how="left_semi")
    dropped = salted_lookup(chunks, agreed, ["source_code"], spread_by=spread, how="left_anti")
    text = F.format_string(
        "chunk %s references non-pilot/non-agreed source '%s'; excluded from the report",
        "edge_chunk_id",
        "source_code",
    )
    return kept, dropped.select("edge_chunk_id", "source_code", text.alias("warning"))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_code").agg(F.count(F.lit(1)).alias("chunk_count"))


def top_supplied(chunks: DataFrame, candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each chunk's first candidate, its names filled from the catalog, then the id."""
    first = candidates.where(F.col("rank") == 0).drop("rank")
    names = catalog.select(
        "recording_id", F.col("title").alias("_title"), F.col("artist").alias("_artist")
    )
    filled = lambda c: F.when(~is_blank(c), F.col(c))
    plays = chunks.join(first, "edge_chunk_id")
    return salted_lookup(plays, names, ["recording_id"], spread_by=["edge_chunk_id"]).withColumns(
        {
            "title": F.coalesce(filled("title"), filled("_title"), F.col("recording_id").cast("string")),
            "artist": F.coalesce(filled("artist"), filled("_artist")),
        }
    ).drop("_title", "_artist")


def _routes(*routes: tuple[str, Column]) -> Column:
    """The usable (route, key) pairs of a row."""
    pairs = [
        F.when(key.isNotNull(), F.struct(F.lit(route).alias("route"), key.alias("key")))
        for route, key in routes
    ]
    return F.explode(F.filter(F.array(*pairs), lambda p: p.isNotNull()))


def _text_key(title: str | Column, artist: str | Column) -> Column:
    key = title_artist_key(title, artist)
    return F.when(key != "|", key)


def _nonblank_upper(value: str) -> Column:
    return F.when(F.col(value) != "", F.upper(F.col(value)))


def candidate_routes(candidates: DataFrame, catalog: DataFrame) -> DataFrame:
    """Candidates by recording id, ISRC and title|artist key."""
    names = catalog.select(
        "recording_id",
        F.col("title").alias("_title"),
        F.col("artist").alias("_artist"),
        F.col("isrc").alias("_isrc"),
    )
    known = salted_lookup(candidates, names, ["recording_id"], spread_by=["detection_id"])
    named = lambda mine, own: F.coalesce(F.when(F.col(mine) != "", F.col(mine)), F.col(own))
    return known.select(
        "source_code",
        "detection_id",
        F.unix_micros(midpoint("started_at", "ended_at")).alias("at_us"),
        _routes(
            ("id", F.col("recording_id").cast("string")),
            ("isrc", _nonblank_upper("_isrc")),
            ("text", _text_key(named("_title", "title"), named("_artist", "artist"))),
        ).alias("r"),
    )


def log_routes(logs: DataFrame) -> DataFrame:
    """Log rows by the same three kinds of key."""
    return logs.select(
        "source_code",
        "log_index",
        F.unix_micros("aired_at").alias("at_us"),
        _routes(
            ("id", F.when(F.col("recording_id").cast("string") != "", F.col("recording_id").cast("string"))),
            ("isrc", _nonblank_upper("isrc")),
            ("text", _text_key("title", "artist")),
        ).alias("r"),
    )


def reconcile_log(
    candidates: DataFrame,
    logs: DataFrame,
    catalog: DataFrame,
    tolerance_seconds: float = TOLERANCE_SECONDS,
) -> DataFrame:
    """Each candidate with the first log row that confirms it, or NULL.

    Both sides are laid out on the time axis of (source, route, key) and one range
    frame finds the smallest log index within the tolerance. No candidate-log pair is
    ever built. The axis is cut into buckets, with log rows copied across an edge they
    can reach over.
    """
    tolerance = int(tolerance_seconds * 1_000_000)
    width = max(2 * tolerance, 3_600_000_000)
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    t = F.col("at_us")
    left = candidate_routes(candidates, catalog).select(
        "source_code", "r", t, bucket(t).alias("bucket"), "detection_id", F.lit(None).cast("long").alias("log_index")
    )
    right = log_routes(logs).select(
        "source_code",
        "r",
        t,
        F.explode(F.sequence(bucket(t - tolerance), bucket(t + tolerance))).alias("bucket"),
        F.lit(None).cast(candidates.schema["detection_id"].dataType).alias("detection_id"),
        F.col("log_index").cast("long").alias("log_index"),
    )
    near = (
        Window.partitionBy("source_code", "r", "bucket").orderBy("at_us").rangeBetween(-tolerance, tolerance)
    )
    best = (
        left.unionByName(right)
        .withColumn("log_index", F.min("log_index").over(near))
        .where(F.col("detection_id").isNotNull())
        .groupBy("source_code", "detection_id")
        .agg(F.min("log_index").alias("log_index"))
    )
    return candidates.join(best.hint("merge"), ["source_code", "detection_id"], "left").withColumn(
        "log_reconciliation",
        F.when(F.col("log_index").isNotNull(), "confirmed_by_log").otherwise("candidate_not_in_log"),
    )


def log_gaps(logs: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Log rows no candidate was confirmed by."""
    matched = reconciled.where(F.col("log_index").isNotNull()).select("source_code", "log_index").distinct()
    return logs.join(matched.hint("merge"), ["source_code", "log_index"], "left_anti")


def classify_gap(gaps: DataFrame, catalog: DataFrame) -> DataFrame:
    """Gaps with ``is_known``: a missed catalog recording, or local repertoire outside it.

    The three catalog key sets become one lookup; a blank title and artist count as
    the key ``|`` here, unlike in matching.
    """
    catalog_keys = (
        catalog.select(
            F.explode(
                F.array(
                    F.struct(F.lit("id").alias("route"), F.col("recording_id").cast("string").alias("key")),
                    F.struct(F.lit("isrc").alias("route"), _nonblank_upper("isrc").alias("key")),
                    F.struct(F.lit("text").alias("route"), title_artist_key("title", "artist").alias("key")),
                )
            ).alias("r")
        )
        .where("r.key is not null")
        .distinct()
    )
    row = ["source_code", "log_index"]
    found = gaps.where("known_catalog").select(
        *row,
        _routes(
            ("id", F.when(F.col("recording_id").cast("string") != "", F.col("recording_id").cast("string"))),
            ("isrc", _nonblank_upper("isrc")),
            ("text", title_artist_key("title", "artist")),
        ).alias("r"),
    )
    known = salted_lookup(found, catalog_keys, ["r"], spread_by=row, how="left_semi")
    return gaps.join(
        known.select(*row).distinct().withColumn("is_known", F.lit(True)).hint("merge"), row, "left"
    ).withColumn("is_known", F.coalesce("is_known", F.lit(False)))


def split_gaps(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(local repertoire for outreach, possible false negatives)."""
    return classified.where(~F.col("is_known")), classified.where(F.col("is_known"))


def reconciliation_rows(sources: DataFrame, reconciled: DataFrame, classified: DataFrame) -> DataFrame:
    """Per listed source: confirmed, not in log, false negatives, gaps and agreement."""
    confirmed = F.col("log_index").isNotNull()
    by_candidate = reconciled.groupBy("source_code").agg(
        F.count_if(confirmed).alias("confirmed_by_log"),
        F.count_if(~confirmed).alias("candidate_not_in_log"),
    )
    by_gap = classified.groupBy("source_code").agg(
        F.count_if("is_known").alias("possible_false_negatives"),
        F.count_if(~F.col("is_known")).alias("local_repertoire_gaps"),
    )
    counts = ["confirmed_by_log", "candidate_not_in_log", "possible_false_negatives", "local_repertoire_gaps"]
    return (
        sources.select("source_code")
        .join(by_candidate, "source_code", "left")
        .join(by_gap, "source_code", "left")
        .na.fill(0, counts)
        .withColumn(
            "agreement_rate",
            ratio("confirmed_by_log", F.col("confirmed_by_log") + F.col("candidate_not_in_log")),
        )
    )


def scorecard(sources: DataFrame, reconciled: DataFrame, log_rows: DataFrame) -> DataFrame:
    """Review counts and precision per source, beside its log agreement. Never blended."""
    status = F.col("status")
    counted = reconciled.groupBy("source_code").agg(
        F.count(F.lit(1)).alias("total_candidates"),
        F.count_if(status == "verified").alias("verified"),
        F.count_if(status == "rejected").alias("rejected"),
        F.count_if(status.isin("candidate", "disputed")).alias("unreviewed"),
    )
    joined = (
        sources.select("source_code")
        .join(counted, "source_code", "left")
        .na.fill(0, ["total_candidates", "verified", "rejected", "unreviewed"])
        .join(log_rows.drop("confirmed_by_log", "candidate_not_in_log"), "source_code")
    )
    reviewed = F.col("verified") + F.col("rejected")
    return joined.withColumn("reviewed", reviewed).withColumn("precision", ratio("verified", reviewed)).withColumnRenamed(
        "agreement_rate", "log_agreement_rate"
    )


def precision_slices(reviewed: DataFrame) -> DataFrame:
    """Precision per confidence band, tempo shift and region; undecided rows are skipped."""
    hint = F.coalesce("confidence_hint", F.lit(0.0))
    band = F.when(hint >= 0.6, "high").when(hint >= 0.35, "medium").otherwise("low")
    scale = F.col("tempo_scale")
    tempo = (
        F.when(scale.isNull(), None)
        .when(F.abs(scale - 1.0) < 0.025, "unshifted")
        .when(scale > 1.0, "sped_up")
        .otherwise("slowed_down")
    )
    region = F.when(F.col("region") != "", F.col("region"))
    named = [("confidence_band", band), ("tempo", tempo), ("region", region)]
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), v.alias("value")) for d, v in named])
    return (
        reviewed.where(F.col("status").isin("verified", "rejected"))
        .select("source_code", "status", F.explode(pairs).alias("s"))
        .where("s.value is not null")
        .groupBy("source_code", F.col("s.dimension").alias("dimension"), F.col("s.value").alias("value"))
        .agg(
            F.count(F.lit(1)).alias("reviewed"),
            F.count_if(F.col("status") == "verified").alias("verified"),
            F.count_if(F.col("status") == "rejected").alias("rejected"),
        )
        .withColumn("precision", ratio("verified", "reviewed"))
    )


def review_outcomes(candidates: DataFrame) -> DataFrame:
    """One row of counts for the four review states; any other state counts as candidate."""
    state = F.when(F.col("status").isin(*REVIEW_STATES), F.col("status")).otherwise("candidate")
    return candidates.agg(*[F.count_if(state == s).alias(s) for s in REVIEW_STATES])


def filter_period(candidates: DataFrame, start: object, end: object) -> DataFrame:
    """Optional: keep plays that start inside the period. The report itself does not."""
    return candidates.where((F.col("started_at") >= F.lit(start)) & (F.col("started_at") < F.lit(end)))


def chunks_without_candidates(chunks: DataFrame, candidates: DataFrame) -> DataFrame:
    return chunks.join(candidates.select("edge_chunk_id").distinct(), "edge_chunk_id", "left_anti")


def both_way_gaps(chunks: DataFrame, candidates: DataFrame, gaps: DataFrame) -> DataFrame:
    """Per source: chunks no candidate was found in, and log rows no candidate confirmed."""
    silent = chunks_without_candidates(chunks, candidates).select(
        "source_code", F.lit("chunk_without_candidate").alias("gap")
    )
    unheard = gaps.select("source_code", F.lit("log_without_candidate").alias("gap"))
    return silent.unionByName(unheard).groupBy("source_code", "gap").agg(F.count(F.lit(1)).alias("rows"))
