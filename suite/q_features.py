"""Signal features: clips and spectra from embeddings, frame features from events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinledger.config import SegmenterConfig
from spinledger.functions.columns import confidence_hint
from spinledger.functions.lineage import cut
from spinledger.operators import features as feat
from suite.projections import SPECTRUM_CONFIG, Tables
from suite.registry import query

FRAMES = SegmenterConfig(sample_rate=2, hop_size=1)
BIN_HZ = SPECTRUM_CONFIG.sample_rate / SPECTRUM_CONFIG.window_size

SAMPLES = "(select vec_id as clip_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as x from embeddings)"


@query(
    "resampled_clips",
    f"""select clip_id, count(*) as samples, round(sum(v), 4) as total from (
      select c.clip_id, k, a.x * (1.0 - (k * (64.0::double / 40.0) - floor(k * (64.0::double / 40.0)))) + b.x * (k * (64.0::double / 40.0) - floor(k * (64.0::double / 40.0))) as v
      from (select vec_id as clip_id, unnest(range(0, 40)) as k from embeddings) c
      join {SAMPLES} a on a.clip_id = c.clip_id and a.i = least(floor(k * (64.0::double / 40.0)), 63)
      join {SAMPLES} b on b.clip_id = c.clip_id and b.i = least(floor(k * (64.0::double / 40.0)) + 1, 63)) group by 1""",
)
def _(t: Tables) -> DataFrame:
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return feat.resample(t.clips, 40).select("clip_id", F.size("samples").cast("bigint").alias("samples"), F.round(total, 4).alias("total"))


@query(
    "normalized_clips",
    f"""select clip_id, 1.0::double as top, round(sum(y * y) / max(abs(y)) / max(abs(y)), 4) as energy from
      (select clip_id, x - avg(x) over (partition by clip_id) as y from {SAMPLES}) group by 1""",
)
def _(t: Tables) -> DataFrame:
    energy = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x * x)
    top = F.array_max(F.transform("samples", F.abs))
    return feat.normalize_level(t.clips).select("clip_id", top.alias("top"), F.round(energy, 4).alias("energy"))


@query(
    "clip_frames",
    f"""select clip_id, frame, count(x) as valid, round(coalesce(sum(x), 0.0), 5) as total from (select vec_id as clip_id, unnest(range(0, 4)) as frame from embeddings) f
      left join {SAMPLES} s on s.clip_id = f.clip_id and i between frame * 16 and frame * 16 + 31 group by all""".replace("select clip_id, frame", "select f.clip_id, frame", 1),
)
def _(t: Tables) -> DataFrame:
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return feat.frames(t.clips, 32, 16).select(
        "clip_id", F.col("frame").cast("bigint").alias("frame"), F.col("valid").cast("bigint").alias("valid"), F.round(total, 5).alias("total")
    )


@query(
    "clip_spectra",
    f"""select clip_id, b as bin, round(sqrt(pow(sum(y * cos(2 * pi() * b * i / 64)), 2) + pow(sum(y * sin(2 * pi() * b * i / 64)), 2)), 4) as magnitude
      from (select clip_id, i, x * (0.5 - 0.5 * cos(2 * pi() * i / 63)) as y from {SAMPLES}), (select unnest(range(0, 33)) as b) group by 1, 2""",
)
def _(t: Tables) -> DataFrame:
    spectra = feat.spectrogram(feat.frames(t.clips, 64, 64))
    return spectra.select("clip_id", F.posexplode("magnitudes").alias("bin", "m")).select(
        "clip_id", F.col("bin").cast("bigint").alias("bin"), F.round("m", 4).alias("magnitude")
    )


# Bands 2 to 62, three bins and one frame around, at most four peaks a frame.
PEAKS = """
band as (select *, max(case when bin between 2 and 62 then m end) over (partition by clip_id) as cmax, max(case when bin between 2 and 62 then m end) over (partition by clip_id, frame) as fmax,
   max(m) over (partition by clip_id, frame order by bin rows between 3 preceding and 3 following) as nmax,
   max(m) over (partition by clip_id, bin order by frame rows between 1 preceding and 1 following) as tmax from spectrum),
pk as (select clip_id, frame, bin, m from band where bin between 5 and 59 and m >= greatest(cmax * pow(10, -52 / 20.0), fmax * pow(10, -28 / 20.0)) and m >= nmax and m + 1e-12 >= tmax * 0.985
   qualify row_number() over (partition by clip_id, frame order by m desc, bin) <= 4)"""


def peaks(t: Tables) -> DataFrame:
    return feat.find_peaks(t.spectra, SPECTRUM_CONFIG)


@query("spectral_peaks", f"select * from (with {PEAKS.strip()} select clip_id, frame, bin, round(m, 6) as magnitude from pk)")
def _(t: Tables) -> DataFrame:
    return peaks(t).select("clip_id", F.col("frame").cast("bigint").alias("frame"), F.col("bin").cast("bigint").alias("bin"), F.round("magnitude", 6).alias("magnitude"))


PAIRS = f"""{PEAKS.strip()},
pr as (select a.clip_id, a.frame, a.m, a.bin, b.frame - a.frame as delta_frames, cast(round_even(48 * log2((b.bin + 0.5) / (a.bin + 0.5)), 0) as int) as ratio_bin,
   row_number() over (partition by a.clip_id, a.frame, a.bin order by b.frame, b.m desc, b.bin) as nth
  from pk a join pk b on a.clip_id = b.clip_id and b.frame between a.frame + 1 and a.frame + 3 qualify nth <= 3)"""


@query(
    "spectral_landmarks",
    f"""select * from (with {PAIRS} select clip_id, row_number() over (partition by clip_id order by frame, m desc, bin, nth) - 1 as hash_index, frame as anchor_frame, ratio_bin, delta_frames from pr)""",
)
def _(t: Tables) -> DataFrame:
    marks = feat.pair_peaks(peaks(t), SPECTRUM_CONFIG)
    return marks.select("clip_id", F.col("hash_index").cast("bigint").alias("hash_index"), F.col("anchor_frame").cast("bigint").alias("anchor_frame"), "ratio_bin", F.col("delta_frames").cast("bigint").alias("delta_frames"))


@query(
    "fingerprint_summary",
    f"""select * from (with {PAIRS} select c.clip_id, coalesce(p.n, 0) as peaks, coalesce(l.n, 0) as landmarks, 1.0::double as duration_seconds from (select vec_id as clip_id from embeddings) c
      left join (select clip_id, count(*) as n from pk group by 1) p using (clip_id) left join (select clip_id, count(*) as n from pr group by 1) l using (clip_id))""",
)
def _(t: Tables) -> DataFrame:
    found = peaks(t)
    summary = feat.fingerprint_summary(t.clips, found, feat.pair_peaks(found, SPECTRUM_CONFIG), "v1")
    return summary.select("clip_id", "peaks", "landmarks", "duration_seconds")


@query(
    "spectral_features",
    """select clip_id, frame, round(sum(bin * m) / (sum(m) + 1e-12), 5) as centroid, round(coalesce(sum(greatest(0.0, m - p)) / (sum(p) + 1e-12), 0.0), 5) as flux
      from (select *, lag(m) over (partition by clip_id, bin order by frame) as p from spectrum) group by 1, 2""",
)
def _(t: Tables) -> DataFrame:
    return feat.spectral_features(t.spectra, BIN_HZ).select(
        "clip_id", F.col("frame").cast("bigint").alias("frame"), F.round("spectral_centroid_hz", 5).alias("centroid"), F.round("spectral_flux", 5).alias("flux")
    )


@query(
    "clip_levels",
    f"""select clip_id, i // 16 as frame, round(20 * log10(greatest(sqrt(sum(x * x) over (partition by clip_id order by i rows between current row and 31 following)
      / count(*) over (partition by clip_id order by i rows between current row and 31 following)), 1e-12)), 4) as rms_db from {SAMPLES} qualify i % 16 = 0""",
)
def _(t: Tables) -> DataFrame:
    cfg = SegmenterConfig(sample_rate=64, window_size=32, hop_size=16)
    return feat.frame_features(t.clips, cfg).select(
        F.col("session_id").alias("clip_id"), F.col("frame").cast("bigint").alias("frame"), F.round("rms_db", 4).alias("rms_db")
    )


@query(
    "feature_deltas",
    "select session_id, frame, flux, round(level_change, 6) as level_change, round(centroid_change, 6) as centroid_change from deltas",
)
def _(t: Tables) -> DataFrame:
    return feat.feature_deltas(t.frame_features).select(
        "session_id", F.col("frame").cast("bigint").alias("frame"), "flux", F.round("level_change", 6).alias("level_change"), F.round("centroid_change", 6).alias("centroid_change")
    )


@query("exact_medians", "select session_id, round(med, 6) as median, round(mad, 6) as mad from mads where measure = 'flux'")
def _(t: Tables) -> DataFrame:
    stats = feat.median_and_mad(t.frame_features.select("session_id", "frame", "spectral_flux"), ["session_id"], "spectral_flux")
    return stats.select("session_id", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@query(
    "robust_z",
    "select session_id, frame, round((flux - med) / greatest(mad * 1.4826, 1e-6), 4) as z from deltas join (select * from mads where measure = 'flux') using (session_id)",
)
def _(t: Tables) -> DataFrame:
    rows = t.frame_features.select("session_id", "frame", "spectral_flux")
    joined = rows.join(feat.median_and_mad(rows, ["session_id"], "spectral_flux"), "session_id")
    z = feat.robust_z(F.col("spectral_flux"), F.col("median"), F.col("mad"))
    return joined.select("session_id", F.col("frame").cast("bigint").alias("frame"), F.round(z, 4).alias("z"))


def rough(t: Tables) -> DataFrame:
    return feat.novelty(feat.feature_deltas(t.frame_features))


@query("novelty", "select session_id, frame, round(novelty, 4) as novelty from novel")
def _(t: Tables) -> DataFrame:
    return rough(t).select("session_id", F.col("frame").cast("bigint").alias("frame"), F.round("novelty", 4).alias("novelty"))


@query("moving_average", "select session_id, frame, round(score, 4) as score from scores")
def _(t: Tables) -> DataFrame:
    return feat.moving_average(rough(t), "novelty", 2, "score").select("session_id", F.col("frame").cast("bigint").alias("frame"), F.round("score", 4).alias("score"))


@query("local_maxima", "select session_id, frame, round(score, 4) as score from tops")
def _(t: Tables) -> DataFrame:
    scores = cut(feat.moving_average(rough(t), "novelty", 2, "score"))
    return feat.local_maxima(scores, FRAMES).select("session_id", F.col("frame").cast("bigint").alias("frame"), F.round("score", 4).alias("score"))


@query(
    "acoustic_boundaries",
    """select session_id, at_seconds, novelty_score from (with recursive o as (select session_id, at_seconds, score, row_number() over (partition by session_id order by at_seconds) as n from tops),
      g as (select session_id, n, at_seconds, score, true as kept, at_seconds as last from o where n = 1
        union all select o.session_id, o.n, o.at_seconds, o.score, o.at_seconds - g.last >= 8, case when o.at_seconds - g.last >= 8 then o.at_seconds else g.last end from g join o on o.session_id = g.session_id and o.n = g.n + 1)
      select session_id, at_seconds, round(score, 5) as novelty_score from g where kept)""",
)
def _(t: Tables) -> DataFrame:
    return feat.acoustic_boundaries(t.frame_features, FRAMES).select("session_id", "at_seconds", "novelty_score")


@query(
    "window_quality",
    f"""select clip_id, round(count(*) filter (abs(x) < 0.02) / count(*), 6) as silence_ratio, round(count(*) filter (abs(x) >= 0.25) / count(*), 6) as clipping_ratio,
      case when count(*) filter (abs(x) >= 0.25) / count(*) > 0.05 then 'quarantined' else 'ready' end as route from {SAMPLES} group by 1""",
)
def _(t: Tables) -> DataFrame:
    judged = feat.route_quality(feat.window_quality(t.clips, silence=0.02, clipping=0.25))
    return judged.select("clip_id", "silence_ratio", "clipping_ratio", "route")


@query(
    "confidence_hints",
    """select l_orderkey, l_linenumber, count(*) as n, round(sum(hint), 3) as hints from (select l_orderkey, l_linenumber,
       round(least(l_quantity / 50.0, 1.0 - l_discount) * least(1.0, l_quantity / 20.0), 4) as hint from lineitem) group by 1, 2""",
)
def _(t: Tables) -> DataFrame:
    quantity = F.col("l_quantity")
    hint = confidence_hint(quantity, quantity / 50.0, 1.0 - F.col("l_discount"))
    return t.raw("lineitem").select("l_orderkey", "l_linenumber", hint.alias("hint")).groupBy("l_orderkey", "l_linenumber").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("hint"), 3).alias("hints")
    )
