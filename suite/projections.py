"""The driver's tables seen as domain tables. ``sqltext`` holds the same in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spinledger.config import FingerprintConfig
from spinledger.functions.skew import salted_lookup
from spinledger.operators.alignments import Extractor
from spinledger.operators.features import pair_listed_peaks, pair_ordered_peaks

TEXT_CONFIG = FingerprintConfig(
    sample_rate=10, hop_size=1, max_peaks_per_frame=1, max_delta_frames=4, fanout=2, ratio_quantization=4096
)
TEXT_SCHEMA = "tokens-v1"
#: Bytes of documents times landmarks of the index, for one task.
BYTE_PAIRS_PER_TASK = 50_000_000_000
#: Bytes of texts whose landmarks a task makes at once.
TEXT_BYTES = 1 << 18
SPECTRUM_CONFIG = FingerprintConfig(
    sample_rate=128, window_size=128, hop_size=64, min_frequency_hz=2.0, max_frequency_hz=62.0,
    bin_radius=3, frame_radius=1, max_peaks_per_frame=4, max_delta_frames=3, fanout=3,
)


def word_peaks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:meth:`Tables.peak_lists` of texts without nulls, for use inside tasks: text, frame and bin of every word."""
    codes = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum(pc.utf8_length(texts).to_numpy().astype(np.int64))
    spaces = np.flatnonzero(codes == ord(" "))
    start = np.sort(np.concatenate([np.append(0, ends)[:-1], spaces + 1]), kind="stable")
    end = np.sort(np.concatenate([ends, spaces]), kind="stable")
    length = end - start
    at = np.append(codes, 0).astype(np.int64)
    code = lambda n: np.where(length > n, at[np.minimum(start + n, len(codes))], 0)
    last = np.where(length > 0, at[np.maximum(end - 1, 0)], 0)
    total = code(0) * 7919 + code(1) * 104729 + code(2) * 1299709 + last * 15485863 + length * 31
    words = pc.count_substring(texts, " ").to_numpy().astype(np.int64) + 1
    text = np.repeat(np.arange(len(texts)), words)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(words) - words, words), 1 + total % 65521


def text_landmarks(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """The landmarks of a batch of documents."""
    batch = batch.filter(pc.is_valid(batch["text"]))
    size = np.cumsum(pc.binary_length(batch["text"]).to_numpy())
    first = 0
    while first < batch.num_rows:
        before = size[first - 1] if first else 0
        n = max(1, int(np.searchsorted(size, before + TEXT_BYTES, side="right")) - first)
        some = batch.slice(first, n)
        text, frame, bins = word_peaks(some["text"])
        anchor, ratio, delta = pair_ordered_peaks(text, frame, bins, TEXT_CONFIG)
        of = text[anchor]
        hashes = np.bincount(of, minlength=n)
        yield pa.table(
            {
                "query_id": some["doc_id"].take(pa.array(of)),
                "schema_id": pa.DictionaryArray.from_arrays(np.zeros(len(of), dtype=np.int32), [TEXT_SCHEMA]).cast("string"),
                "query_index": (np.arange(len(of)) - (np.cumsum(hashes) - hashes)[of]).astype(np.int32),
                "anchor_frame": frame[anchor].astype(np.int32),
                "ratio_bin": ratio,
                "delta_frames": delta,
                "query_hashes": hashes[of],
            }
        )
        first += n


class Tables:
    """Lazy domain tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def sources(self) -> DataFrame:
        key = F.col("n_nationkey")
        kind = (
            F.when(key % 4 == 0, "fm_stream").when(key % 4 == 1, "online_stream").when(key % 4 == 2, "venue_edge")
        ).otherwise("vehicle_edge")
        return self.raw("nation").join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
            key.cast("bigint").alias("source_id"),
            F.col("n_name").alias("source_code"),
            F.concat(F.lit("Station "), "n_name").alias("display_name"),
            F.col("r_name").alias("region"),
            kind.alias("source_type"),
            (key % 5 != 0).alias("agreed"),
        )

    @property
    def recordings(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.raw("part").select(
            key.alias("recording_id"),
            (key % 7).alias("catalog_id"),
            F.col("p_name").alias("title"),
            F.col("p_brand").alias("artist"),
            F.concat(F.lit("UGAAA"), F.lpad(key.cast("string"), 7, "0")).alias("isrc"),
            (F.lit(120) + F.col("p_size")).cast("bigint").alias("reference_seconds"),
        )

    @property
    def usage(self) -> DataFrame:
        first = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.min("l_partkey").alias("recording_id")
        )
        status = F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "candidate")
        return (
            self.raw("orders")
            .join(self.raw("customer").hint("merge"), F.col("o_custkey") == F.col("c_custkey"))
            .join(first, "o_orderkey")
            .join(self.recordings.hint("merge"), "recording_id")
            .select(
                F.col("o_orderkey").alias("usage_id"),
                F.col("c_nationkey").cast("bigint").alias("source_id"),
                "recording_id",
                "catalog_id",
                F.to_date("o_orderdate").alias("used_on"),
                status.otherwise("disputed").alias("status"),
                (F.lit(10) + F.col("o_orderkey") % 170).alias("detected_seconds"),
                "reference_seconds",
                (F.lit(100) + F.col("recording_id") % 50).alias("base_rate_ugx"),
            )
        )

    @property
    def split_lines(self) -> DataFrame:
        rec = F.col("recording_id")
        half = F.floor((9000 - rec % 5000) / 2)
        no = F.col("line_no")
        rest = 9000 - rec % 5000 - half - F.when(rec % 97 == 0, 1).otherwise(0)
        share = F.when(no == 1, 1000 + rec % 5000).when(no == 2, half).otherwise(rest)
        numbered = self.recordings.select("recording_id", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("line_no"))
        return numbered.select(
            rec.alias("split_sheet_id"),
            (rec * 10 + no).alias("split_line_id"),
            no.alias("line_no"),
            ((rec * 3 + no) % 10).alias("party_id"),
            F.concat(F.lit("role"), no.cast("string")).alias("role"),
            share.cast("int").alias("share_basis_points"),
        )

    @property
    def recording_works(self) -> DataFrame:
        """A work for every recording, a second one for each tenth."""
        rec = F.col("recording_id")
        first, second = [F.struct((w % 500).alias("work_id"), F.lit(p).alias("is_primary_work")) for w, p in ((rec, True), (rec + 250, False))]
        links = F.when(rec % 10 == 0, F.array(first, second)).otherwise(F.array(first))
        return self.recordings.select("recording_id", F.inline(links))

    @property
    def sheets(self) -> DataFrame:
        rec = F.col("recording_id")
        master = self.recordings.select(
            rec.alias("split_sheet_id"),
            F.when(rec % 23 == 0, (rec + 1) % 7).otherwise(F.col("catalog_id")).alias("catalog_id"),
            rec.alias("recording_id"),
            F.lit(None).cast("bigint").alias("work_id"),
            F.lit("master").alias("right_type"),
            F.lit(1).alias("version"),
            F.when(rec % 11 == 0, "draft").otherwise("active").alias("status"),
            F.make_date(F.lit(1994) + (rec % 5).cast("int"), F.lit(1), F.lit(1)).alias("valid_from"),
            F.when(rec % 13 == 0, F.make_date(F.lit(2000), F.lit(6), F.lit(30))).alias("valid_to"),
            F.when(rec % 17 != 0, F.concat(F.lit("doc-"), rec.cast("string"))).alias("source_document_key"),
        )
        work = F.col("work_id")
        other = self.recording_works.select("work_id").distinct().select(
            (work + 1_000_000).alias("split_sheet_id"),
            (work % 7).alias("catalog_id"),
            F.lit(None).cast("bigint").alias("recording_id"),
            work.alias("work_id"),
            F.lit("composition").alias("right_type"),
            F.lit(1).alias("version"),
            F.when(work % 6 == 0, "retired").otherwise("active").alias("status"),
            F.make_date(F.lit(1995) + (work % 3).cast("int"), F.lit(7), F.lit(1)).alias("valid_from"),
            F.lit(None).cast("date").alias("valid_to"),
            F.lit(None).cast("string").alias("source_document_key"),
        )
        return master.unionByName(other)

    @property
    def weights(self) -> DataFrame:
        listed = self.raw("nation").select("n_nationkey").withColumn(
            "yr", F.explode(F.sequence(F.lit(1994), F.lit(2001)))
        )
        pct = 50 + ((F.col("n_nationkey") + F.col("yr")) % 4) * 25
        return listed.select(
            (F.col("n_nationkey") * 10 + F.col("yr") - 1994).cast("bigint").alias("weight_id"),
            F.col("n_nationkey").cast("bigint").alias("source_id"),
            F.make_date("yr", F.lit(1), F.lit(1)).alias("valid_from"),
            F.when(F.col("yr") != 2001, F.make_date("yr", F.lit(12), F.lit(31))).alias("valid_to"),
            pct.cast("bigint").alias("weight_pct"),
            (pct / 100).cast("decimal(12,6)").alias("weight"),
        )

    @property
    def tariffs(self) -> DataFrame:
        key = F.col("n_nationkey")
        kind = F.when(key % 4 == 0, "fm_stream").when(key % 4 == 1, "online_stream").when(key % 4 == 2, "venue_edge")
        return self.raw("nation").select(
            key.cast("bigint").alias("tariff_id"),
            (key % 7).cast("bigint").alias("catalog_id"),
            F.lit("master").alias("right_type"),
            F.when(key % 3 != 0, kind.otherwise("vehicle_edge")).alias("source_type"),
            (F.lit(100) + key).cast("decimal(18,4)").alias("base_rate_ugx"),
            F.make_date(F.lit(1994) + key % 5, F.lit(1), F.lit(1)).alias("valid_from"),
            F.when(key % 2 == 1, F.make_date(F.lit(1999), F.lit(12), F.lit(31))).alias("valid_to"),
        )

    @property
    def windows(self) -> DataFrame:
        e = F.col("event_id")
        return self.raw("events").select(
            e.alias("event_id"),
            (F.col("user_id") % 5).alias("session_id"),
            F.col("event_type").alias("track_id"),
            (e * 2).cast("double").alias("started_at_seconds"),
            (e * 2 + 20 + e % 37).cast("double").alias("ended_at_seconds"),
            ((e * 7 % 100) / 100.0).alias("confidence"),
        )

    @property
    def sessions(self) -> DataFrame:
        return self.raw("events").groupBy((F.col("user_id") % 5).alias("session_id")).agg(
            (F.max("event_id") * 2 - 100).cast("double").alias("duration_seconds")
        )

    @property
    def candidates(self) -> DataFrame:
        e = F.col("event_id")
        start = F.col("ts").cast("timestamp")
        status = F.when(e % 4 == 0, "verified").when(e % 4 == 1, "rejected").when(e % 4 == 2, "candidate")
        scale = F.when(e % 5 == 1, 0.9).when(e % 5 == 2, 1.0).when(e % 5 == 3, 1.05).when(e % 5 == 4, 1.0)
        return self.raw("events").where(F.col("event_type").isin("click", "purchase", "signup")).select(
            e.alias("detection_id"),
            (F.col("user_id") % 25).cast("string").alias("source_code"),
            (F.col("user_id") % 50).alias("recording_id"),
            F.lit(None).cast("string").alias("title"),
            F.lit(None).cast("string").alias("artist"),
            start.alias("started_at"),
            (start + F.expr("interval 30 seconds")).alias("ended_at"),
            (e % 60).cast("int").alias("votes"),
            ((e % 100) / 100.0).alias("confidence_hint"),
            scale.alias("tempo_scale"),
            status.otherwise("disputed").alias("status"),
        )

    @property
    def station_log(self) -> DataFrame:
        """A third of the rows by id, a third by ISRC, a third by title and artist."""
        e, rec = F.col("event_id"), F.col("user_id") % 50
        named = self.recordings.select(F.col("recording_id").alias("rid"), "title", "artist", "isrc")
        played = self.raw("events").where(F.col("event_type").isin("view", "error")).withColumn("rid", rec)
        rows = salted_lookup(played, named, ["rid"], spread_by=["event_id"])
        return rows.select(
            (F.col("user_id") % 25).cast("string").alias("source_code"),
            e.alias("log_index"),
            F.col("ts").cast("timestamp").alias("aired_at"),
            F.when(e % 11 == 0, "Unlisted!").when(e % 3 == 2, F.upper("title")).otherwise("").alias("title"),
            F.when((e % 3 == 2) & (e % 11 != 0), F.col("artist")).alias("artist"),
            F.when((e % 3 == 0) & (e % 11 != 0), F.col("rid").cast("string")).alias("recording_id"),
            F.when((e % 3 == 1) & (e % 11 != 0), F.lower("isrc")).alias("isrc"),
            (e % 7 != 0).alias("known_catalog"),
        )

    @property
    def pilot_sources(self) -> DataFrame:
        return self.sources.withColumn("source_code", F.col("source_id").cast("string"))

    def peak_lists(self, texts: DataFrame, key: str) -> DataFrame:
        """Every word of a text as a spectral peak: position = frame, a spelling sum = bin."""

        def peak(w: Column, frame: Column) -> Column:
            code = lambda at: F.ascii(F.substring(w, at, F.lit(1))).cast("bigint")
            n = F.length(w)
            total = (
                code(F.lit(1)) * 7919 + code(F.lit(2)) * 104729 + code(F.lit(3)) * 1299709 + code(n) * 15485863 + n * 31
            )
            return F.struct(frame.alias("frame"), (1 + total % 65521).alias("bin"), F.lit(1.0).alias("magnitude"))

        return texts.select(F.col(key).alias("clip_id"), F.transform(F.split("text", " "), peak).alias("peaks"))

    def peaks(self, table: str, key: str) -> DataFrame:
        """The peaks of :meth:`peak_lists`, one row each."""
        return self.peak_lists(self.raw(table), key).select("clip_id", F.inline("peaks"))

    @property
    def index(self) -> DataFrame:
        marks = pair_listed_peaks(self.peak_lists(self.raw("benchmark"), "item_id"), TEXT_CONFIG)
        return marks.select(
            F.col("clip_id").alias("track_id"), "hash_index", "anchor_frame", "ratio_bin", "delta_frames",
            F.lit(TEXT_SCHEMA).alias("schema_id"), F.col("hashes").alias("track_hashes"),
        )

    def landmarks_of(self, documents: DataFrame) -> DataFrame:
        marks = pair_listed_peaks(self.peak_lists(documents, "doc_id"), TEXT_CONFIG)
        return marks.select(
            F.col("clip_id").alias("query_id"),
            F.lit(TEXT_SCHEMA).alias("schema_id"),
            F.col("hash_index").alias("query_index"),
            "anchor_frame",
            "ratio_bin",
            "delta_frames",
            F.col("hashes").alias("query_hashes"),
        )

    @property
    def document_landmarks(self) -> DataFrame:
        return self.landmarks_of(self.raw("documents"))

    def dealt_texts(self, index: DataFrame) -> tuple[DataFrame, Extractor]:
        """The documents dealt by id, and what makes :attr:`document_landmarks` of them inside a task.

        There are as many tasks as keep each to some tens of millions of expected hits.
        """
        texts = self.raw("documents").select("doc_id", "text")
        size = texts.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
        tasks = max(self.spark.sparkContext.defaultParallelism, size * index.count() // BYTE_PAIRS_PER_TASK + 1)
        kind = texts.schema["doc_id"].dataType.simpleString()
        marks = "schema_id string, query_index int, anchor_frame int, ratio_bin int, delta_frames int, query_hashes bigint"
        return texts.repartition(tasks, "doc_id").sortWithinPartitions("doc_id"), Extractor(text_landmarks, f"query_id {kind}, {marks}")

    @property
    def spectra(self) -> DataFrame:
        """Each embedding as one frame of one of ten clips."""
        return self.raw("embeddings").select(
            (F.col("vec_id") % 10).alias("clip_id"),
            F.floor(F.col("vec_id") / 10).cast("int").alias("frame"),
            F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("magnitudes"),
        )

    @property
    def clips(self) -> DataFrame:
        """Each embedding as a clip of 64 samples."""
        return self.raw("embeddings").select(
            F.col("vec_id").alias("clip_id"),
            F.lit(64).alias("sample_rate"),
            F.transform("embedding", lambda x: x.cast("double")).alias("samples"),
        )

    @property
    def frame_features(self) -> DataFrame:
        """Events as frames of four sessions."""
        rows = self.raw("events").select(
            (F.col("event_id") % 4).alias("session_id"),
            F.floor(F.col("event_id") / 4).cast("int").alias("frame"),
            F.col("value"),
            F.col("user_id"),
        )
        return rows.select(
            "session_id",
            "frame",
            (F.col("frame") * 0.5).alias("at_seconds"),
            (F.col("user_id") % 40 - 60).cast("double").alias("rms_db"),
            (F.col("user_id") * 10 + 100).cast("double").alias("spectral_centroid_hz"),
            F.col("value").alias("spectral_flux"),
        )

    @property
    def detections(self) -> DataFrame:
        """One detection per user, for the review commands."""
        u = F.col("user_id")
        status = F.when(u % 5 == 3, "verified").when(u % 5 == 4, "disputed").otherwise("candidate")
        return self.raw("events").select("user_id").distinct().select(u.alias("detection_id"), status.alias("status"))

    @property
    def disputes(self) -> DataFrame:
        u = F.col("user_id")
        return self.raw("events").select("user_id").distinct().where(u % 5 == 4).select(
            u.alias("detection_id"), F.lit("open").alias("status")
        )

    @property
    def commands(self) -> DataFrame:
        e, kind = F.col("event_id"), F.col("event_type")
        command = F.when(kind.isin("view", "click"), "decide").when(kind == "purchase", "open").otherwise("resolve")
        value = (
            F.when(kind == "view", "verified").when(kind == "click", "rejected").when(kind == "signup", "dismissed")
            .when(kind == "error", "upheld")
            .otherwise(F.when(e % 10 == 9, "boredom").otherwise("duplicate"))
        )
        role = F.when(e % 5 == 0, "viewer").when(e % 5 == 1, "reviewer").when(e % 5 == 2, "finance_reviewer")
        return self.raw("events").select(
            F.col("user_id").alias("detection_id"),
            e.alias("seq"),
            command.alias("command"),
            F.concat(F.lit("u"), (e % 9).cast("string")).alias("user_id"),
            role.otherwise("catalog_admin").alias("role"),
            value.alias("value"),
            F.repeat(F.lit("n"), (F.lit(5) + e % 40).cast("int")).alias("note"),
        )

    @property
    def manifests(self) -> DataFrame:
        """One manifest per event; ``event_id % 26`` plants a fault in half of them."""
        e, fault = F.col("event_id"), F.col("event_id") % 26
        iso = F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss")
        later = F.date_format(F.col("ts").cast("timestamp") + F.expr("interval 30 seconds"), "yyyy-MM-dd'T'HH:mm:ss")
        digest = F.sha2(e.cast("string"), 256)
        chunk = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(e.cast("string"), 12, "0"))
        mark = lambda a, r, d: F.struct(
            a.cast("int").alias("anchor_frame"), r.cast("int").alias("frequency_ratio_bin"), d.cast("int").alias("delta_frames")
        )
        return self.raw("events").select(
            F.when(fault == 1, F.concat(F.lit("chunk-"), e.cast("string"))).otherwise(chunk).alias("edge_chunk_id"),
            F.when(fault == 2, "  ").otherwise(F.concat(F.lit("NATION_"), (F.col("user_id") % 30).cast("string"))).alias("source_code"),
            F.concat(F.lit("device-"), (F.col("user_id") % 7).cast("string")).alias("device_id"),
            F.when(fault == 3, iso).otherwise(F.concat(iso, F.lit("Z"))).alias("started_at"),
            F.when(fault == 4, F.concat(iso, F.lit("Z"))).when(fault == 5, "yesterday").otherwise(F.concat(later, F.lit("+00:00"))).alias("ended_at"),
            F.when(fault == 6, F.upper(digest)).otherwise(digest).alias("content_sha256"),
            F.when(fault == 7, -1).otherwise(e * 3).cast("bigint").alias("byte_count"),
            F.when(fault == 8, None).otherwise(F.when(e % 4 == 0, "other-v0").otherwise(TEXT_SCHEMA)).alias("fingerprint_schema_id"),
            F.when(fault == 9, "everything").when(fault == 10, "encrypted_audio").when(e % 3 == 0, "hashes_only").alias("capture_policy"),
            F.when(fault == 11, "key/1").alias("encrypted_object_key"),
            F.lit(None).cast("string").alias("matcher_hint"),
            F.array(
                mark(e % 100, e % 9 - 4, 1 + e % 7),
                mark(e % 50, F.when(fault == 0, None).otherwise(e % 5), F.when(fault == 12, 0).otherwise(F.lit(2))),
            ).alias("landmarks"),
        )

    @property
    def outbox(self) -> DataFrame:
        e, kind = F.col("event_id"), F.col("event_type")
        status = F.when(kind == "view", "pending").when(kind == "click", "retry").when(kind == "purchase", "uploading")
        ts = F.col("ts").cast("timestamp")
        return self.raw("events").select(
            e.alias("chunk_id"),
            (F.col("user_id") % 25).alias("source_id"),
            status.otherwise("uploaded").alias("status"),
            (e % 20).cast("int").alias("attempts"),
            (e * 11 % 5000).alias("byte_count"),
            ts.alias("created_at"),
            (ts + F.expr("interval 1 hour") * (e % 24)).alias("next_attempt_at"),
            F.when(e % 6 == 0, (e % 600).cast("double")).alias("retry_after_seconds"),
            F.repeat(F.lit("x"), (e % 1500).cast("int")).alias("last_error"),
        )
