"""Documents, manifests, review commands, reports and readers on small inputs."""

import json
import random
import struct
import wave

import pytest
from pyspark.sql import functions as F

from spinledger import schemas as S
from spinledger.functions import columns as C
from spinledger.operators import access, catalog, lifecycle, ops, validation
from spinledger.operators import reconciliation as rec
from spinledger.plans.publish import current, publish
from spinledger.plans.report import shadow_report
from spinledger.sources import readers, sinks


def document(**changes):
    doc = {
        "doc_id": "d1", "doc_seq": 1, "catalog_name": "Main", "owner_local_id": "o1",
        "organizations": [{"local_id": "o1", "legal_name": "Label", "organization_type": "label", "registration_number": "R1"}],
        "parties": [
            {"local_id": "p1", "party_kind": "individual", "legal_name": "A"},
            {"local_id": "p2", "party_kind": "organization", "legal_name": "B", "organization_local_id": "o1"},
        ],
        "works": [{"local_id": "w1", "title": "W", "iswc": "t-012.345.678-9", "contributors": [{"party_local_id": "p1", "contributor_role": "composer"}]}],
        "releases": [{"local_id": "r1", "title": "R", "upc_ean": "12345678"}],
        "recordings": [{
            "local_id": "k1", "title": "K", "duration_seconds": 180.5, "isrc": "ugxyz2400001",
            "artist_credits": [{"party_local_id": "p1", "artist_role": "primary", "stage_name": "Star"}],
            "work_local_ids": ["w1"], "release_local_ids": ["r1"],
        }],
        "split_sheets": [{"right_type": "master", "asset_local_id": "k1", "lines": [
            {"party_local_id": "p1", "role": "artist", "share_basis_points": 7000}, {"party_local_id": "p2", "role": "label", "share_basis_points": 3000}]}],
    }
    return {**doc, **changes}


def frame(spark, docs, schema):
    text = spark.createDataFrame([(json.dumps(d),) for d in docs], "v string")
    return text.select(F.from_json("v", schema).alias("d")).select("d.*")




def test_document_is_normalised(spark):
    docs = frame(spark, [document()], S.ONBOARDING)
    assert validation.validate_onboarding(docs).first().errors == []
    new = catalog.flatten_onboarding(docs)
    assert new["recordings"].first().isrc == "UGXYZ2400001" and new["music_works"].first().iswc == "T-012.345.678-9"
    assert new["organizations"].first().country_code == "UG" and new["release_recordings"].first().track_number == 1
    assert new["recording_works"].first().is_primary_work and new["split_sheets"].first().status == "draft"
    assert new["split_lines"].count() == 2


def test_every_error_is_listed(spark):
    bad = document(
        catalog_name=" ",
        owner_local_id="nobody",
        parties=[{"local_id": "p1", "party_kind": "individual", "legal_name": "A", "organization_local_id": "o1"}, {"local_id": "p1", "party_kind": "robot", "legal_name": ""}],
        works=[{"local_id": "w1", "title": "W", "iswc": "123", "contributors": [{"party_local_id": "px", "contributor_role": "drummer", "display_order": 0}]}],
        recordings=[{"local_id": "k1", "title": "K", "duration_seconds": 0, "isrc": "nope", "work_local_ids": ["w9"]}],
        split_sheets=[{"right_type": "composition", "asset_local_id": "k1", "lines": [{"party_local_id": "p7", "role": "x", "share_basis_points": 0}]}],
    )
    errors = validation.validate_onboarding(frame(spark, [bad], S.ONBOARDING)).first().errors
    for text in (
        "catalog_name: required non-empty string", "party.organization_local_id: individual parties must not link an organization",
        "parties: duplicate local_id", "work.iswc: '123' is not a valid ISWC (T-xxx.xxx.xxx-x)", "contributor.display_order: positive integer required",
        "recording.duration_seconds: positive number of seconds (max 6h) required", "recording.isrc: 'nope' is not a valid 12-character ISRC",
        "owner_local_id: must reference an organization in this submission", "recording 'k1': unknown work_local_id 'w9'",
        "work 'w1': contributor references unknown party 'px'", "split_sheet.lines[0].share_basis_points: integer in 1..10000 required",
        "split_sheets[0]: asset_local_id 'k1' is not a work in this submission", "split_sheets[0]: split line references unknown party 'p7'",
    ):
        assert text in errors


def test_refused_document_releases_its_values(spark):
    def doc(n, registration, isrc):
        d = document(doc_id=f"d{n}", doc_seq=n)
        d["organizations"][0]["registration_number"] = registration
        d["recordings"][0]["isrc"] = isrc
        d["works"][0]["iswc"] = None
        return json.loads(json.dumps(d))

    # 1 takes R1 and A; 2 loses to 1 and so frees R2; 3 takes R2; 4 loses to 3; 5 uses a taken ISRC.
    docs = frame(spark, [doc(1, "R1", "UGAAA0000001"), doc(2, "R2", "UGAAA0000001"), doc(3, "R2", "UGAAA0000003"), doc(4, "R4", "UGAAA0000003"), doc(5, "R5", "UGAAA0000009")], S.ONBOARDING)
    tables = {
        "organizations": spark.createDataFrame([], "country_code string, registration_number string"),
        "recordings": spark.createDataFrame([("UGAAA0000009", None)], "isrc string, audio_sha256 string"),
        "music_works": spark.createDataFrame([], "iswc string"),
    }
    stored = spark.createDataFrame([("d0", "c0")], "doc_id string, catalog_id string")
    result = catalog.onboard(docs, tables, stored)
    refused = {r.doc_id: r.conflict for r in result["conflicts"].select("doc_id", "conflict").collect()}
    assert refused == {"d2": "earlier", "d4": "earlier", "d5": "existing"}
    assert result["catalogs"].count() == 2 and result["mapping"].where("kind = 'recording'").count() == 2
    replay = catalog.onboard(docs.withColumn("doc_id", F.when(F.col("doc_id") == "d1", "d0").otherwise(F.col("doc_id"))), tables, stored)
    assert replay["replayed"].first().catalog_id == "c0"


COMMANDS = "detection_id string, seq bigint, command string, user_id string, role string, value string, note string"
NOTE = "a note that is long enough"


@pytest.mark.parametrize("per_slice", [4096, 2])
def test_review_state_matrix(spark, per_slice):
    detections = spark.createDataFrame([("c", "candidate"), ("v", "verified"), ("x", "rejected"), ("d", "disputed")], "detection_id string, status string")
    disputes = spark.createDataFrame([("d", "open")], "detection_id string, status string")
    rows = [
        ("c", 1, "decide", "u", "viewer", "verified", NOTE), ("c", 2, "decide", "u", "reviewer", "maybe", NOTE),
        ("c", 3, "decide", "u", "reviewer", "verified", "short"), ("c", 4, "decide", "u", "reviewer", "verified", NOTE),
        ("c", 5, "decide", "u", "reviewer", "rejected", NOTE), ("c", 6, "open", "u", "viewer", "duplicate", NOTE),
        ("c", 7, "open", "u", "viewer", "duplicate", NOTE), ("c", 8, "resolve", "u", "reviewer", "upheld", NOTE),
        ("c", 9, "resolve", "u", "finance_reviewer", "dismissed", NOTE), ("c", 10, "resolve", "u", "catalog_admin", "upheld", NOTE),
        ("v", 11, "open", "u", "viewer", "boredom", NOTE), ("v", 12, "open", "u", "viewer", "other", "only sixteen chr"),
        ("v", 13, "open", "", "viewer", "other", NOTE), ("v", 14, "open", "u", "viewer", "other", NOTE),
        ("v", 15, "resolve", "u", "catalog_admin", "upheld", NOTE), ("x", 16, "open", "u", "viewer", "other", NOTE),
        ("d", 17, "resolve", "u", "finance_reviewer", "upheld", NOTE), ("none", 18, "open", "u", "viewer", "other", NOTE),
        ("v", 19, "decide", "u", "reviewer", "verified", "n" * 2001),
    ]
    out = lifecycle.apply_commands(detections, disputes, spark.createDataFrame(rows, COMMANDS), per_slice).collect()
    reasons = {r.seq: r.reason for r in out}
    assert reasons == {
        1: "forbidden", 2: "invalid_value", 3: "note_too_short", 4: None, 5: "state_conflict", 6: None, 7: "dispute_already_open", 8: "forbidden",
        9: None, 10: "no_open_dispute", 11: "invalid_value", 12: "note_too_short", 13: "authentication_required", 14: None, 15: None,
        16: "state_conflict", 17: None, 18: "not_found", 19: "note_too_long",
    }
    outcomes = spark.createDataFrame(out)
    final = {r.detection_id: r.status for r in lifecycle.latest_status(detections, outcomes).collect()}
    assert final == {"c": "verified", "v": "rejected", "x": "rejected", "d": "rejected"}


@pytest.mark.parametrize("fan_in", [2, 3, 256])
def test_one_detection_with_most_commands(spark, fan_in):
    made = random.Random(fan_in)
    detections = spark.createDataFrame([("hot", "candidate"), ("cold", "verified")], "detection_id string, status string")
    disputes = spark.createDataFrame([], "detection_id string, status string")
    kinds = [("decide", "verified"), ("decide", "rejected"), ("open", "other"), ("resolve", "upheld"), ("resolve", "dismissed"), ("open", "boredom")]
    numbers = made.sample(range(10**12), 600)  # sparse numbers: slices are counted
    rows = [(made.choice(["hot"] * 9 + ["cold", None, "none"]), seq, *made.choice(kinds), NOTE) for seq in numbers]
    commands = [(d, seq, kind, "u", "catalog_admin", value, note) for d, seq, kind, value, note in rows]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = lifecycle.apply_commands(detections, disputes, spark.createDataFrame(commands, COMMANDS), fan_in).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    number = {"verified": 0, "rejected": 1, "other": 2, "upheld": 3, "dismissed": 4}
    states, expected = {"hot": lifecycle.STATES.index(("candidate", False)), "cold": lifecycle.STATES.index(("verified", False))}, {}
    for d, seq, _, value, _ in sorted(rows, key=lambda r: r[1]):
        state, reason = lifecycle.next_outcome(states.get(d), number.get(value), "invalid_value" if value == "boredom" else None)
        if state is not None:
            states[d] = state
        status, opened = lifecycle.STATES[state] if state is not None else (None, None)
        expected[seq] = (d, reason is None, reason, status, opened)
    assert {r.seq: (r.detection_id, r.accepted, r.reason, r.status_after, r.dispute_open_after) for r in found} == expected and len(found) == 600


def test_identifiers(spark):
    row = spark.range(1).select(
        C.normalize_isrc(F.lit("ug-xyz 24-00001")).alias("a"), C.normalize_isrc(F.lit("UGXYZ240001")).alias("b"),
        C.normalize_iswc(F.lit("0123456789")).alias("c"), C.normalize_iswc(F.lit("T-012.345.678-9")).alias("d"), C.normalize_iswc(F.lit("12")).alias("e"),
        C.title_artist_key(F.lit("  Héllo, World!"), F.lit(None).cast("string")).alias("f"),
    ).first()
    assert tuple(row) == ("UGXYZ2400001", None, "T-012.345.678-9", "T-012.345.678-9", None, "h llo world|")


def test_offsets_of_whole_hours(spark):
    texts = ["2026-07-01T10:00:00+03", "2026-07-01T10:00:00.5-0300", "2026-07-01T10:00Z", "2026-07-01", "2026-07-01T10:00:00"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(C.has_offset(F.col("t"))).collect()] == [True, True, True, False, False]


def test_report_scenario(spark, tmp_path):
    chunk = lambda n: f"00000000-0000-4000-8000-{n:012d}"
    manifests = [
        {"edge_chunk_id": chunk(n), "source_code": source, "started_at": f"2026-07-01T10:0{n}:00Z", "ended_at": f"2026-07-01T10:0{n}:30Z",
         "content_sha256": "a" * 64, "byte_count": 1, "fingerprint_schema_id": "v1", "landmarks": []}
        for n, source in ((1, "s1"), (2, "s1"), (3, "stranger"), (4, "quiet"))
    ] + [{"edge_chunk_id": "bad", "source_code": "s1"}]
    logs = {"s1": [
        {"aired_at": "2026-07-01T10:01:20Z", "title": "Known", "artist": "Star"}, {"aired_at": "2026-07-01T12:00:00Z", "title": "known", "artist": "STAR"},
        {"aired_at": "2026-07-01T13:00:00", "title": "Village song", "artist": "Nobody", "known_catalog": False},
    ], "elsewhere": [{"aired_at": "2026-07-01T13:00:00Z"}]}
    files = {
        "manifests": manifests, "logs": logs, "reviews": {chunk(1): "verified"}, "catalog": {"rec-1": {"title": "Known", "artist": "Star", "isrc": "UGXYZ2400001"}},
        "candidates": {chunk(1): [{"recording_id": "rec-1", "votes": 40, "confidence_hint": 0.6, "tempo_scale": 1.0}], chunk(2): [{"recording_id": "rec-9", "votes": 9}]},
        "sources": [{"source_code": "s1", "display_name": "One", "region": "Kampala"}, {"source_code": "quiet", "display_name": "Q", "region": "Gulu", "agreed": False}],
    }
    for name, content in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(content))
    at = lambda name: str(tmp_path / f"{name}.json")
    report = shadow_report(
        readers.read_manifests(spark, at("manifests")), readers.read_candidates(spark, at("candidates")), readers.read_station_logs(spark, at("logs")),
        readers.read_reviews(spark, at("reviews")), readers.read_catalog(spark, at("catalog")), readers.read_sources(spark, at("sources")),
        period=("2026-07-01", "2026-07-08"),
    )
    cards = {r.source_code: r for r in report["sources"].collect()}
    assert (cards["s1"].chunk_count, cards["s1"].total_candidates, cards["s1"].precision, cards["s1"].log_agreement_rate) == (2, 2, 1.0, 0.5)
    assert (cards["s1"].possible_false_negatives, cards["s1"].local_repertoire_gaps) == (1, 1)
    assert (cards["quiet"].chunk_count, cards["quiet"].total_candidates, cards["quiet"].precision) == (1, 0, None)
    assert report["warnings"].count() == 3
    assert {r.title for r in report["candidates"].collect()} == {"Known", "rec-9"}
    assert report["slices"].where("dimension = 'confidence_band'").first().value == "high"
    sinks.write_report(report, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out" / "sources")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_report({"x": spark.range(1).withColumn("payout_amount", F.lit(1))}, str(tmp_path / "no"))


def test_log_tolerance_across_buckets(spark):
    second = "2026-07-01 00:00:00"
    base = spark.range(0, 400).select(F.col("id"), (F.lit(second).cast("timestamp") + F.expr("interval 1 second") * (F.col("id") * 37)).alias("t"))
    candidates = base.select(
        F.lit("s").alias("source_code"), F.col("id").alias("detection_id"), F.lit("r").alias("recording_id"), F.lit("T").alias("title"),
        F.lit(None).cast("string").alias("artist"), F.col("t").alias("started_at"), F.col("t").alias("ended_at"),
    )
    logs = base.where("id % 5 = 0").select(
        F.lit("s").alias("source_code"), F.col("id").alias("log_index"), (F.col("t") + F.expr("interval 90 seconds")).alias("aired_at"), F.lit("").alias("title"),
        F.lit(None).cast("string").alias("artist"), F.lit("r").alias("recording_id"), F.lit(None).cast("string").alias("isrc"), F.lit(True).alias("known_catalog"),
    )
    empty = spark.createDataFrame([], "recording_id string, title string, artist string, isrc string")
    frame_ = rec.reconcile_log(candidates, logs, empty)
    got = {r.detection_id: r.log_index for r in frame_.collect()}
    for i in range(400):
        near = [j for j in range(0, 400, 5) if abs(j * 37 + 90 - i * 37) <= 90]
        assert got[i] == (min(near) if near else None)
    plan = frame_._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_wav_clips(spark, tmp_path, width):
    peak = 1 << (8 * width - 1)
    values = [0, peak // 2, -peak // 2, peak - 1]
    with wave.open(str(tmp_path / "a.wav"), "wb") as out:
        out.setnchannels(2)
        out.setsampwidth(width)
        out.setframerate(8000)
        for v in values:
            for channel in (v, 0):
                out.writeframes(struct.pack("B", channel + 128) if width == 1 else channel.to_bytes(width, "little", signed=True))
    (tmp_path / "broken.wav").write_bytes(b"nonsense")
    rows = {r.clip_id.rsplit("/", 1)[1]: r for r in readers.read_clips(spark, str(tmp_path)).collect()}
    assert rows["a.wav"].sample_rate == 8000 and rows["broken.wav"].error is not None
    assert rows["a.wav"].samples == [v / peak / 2 for v in values]


def test_retry_clock_and_payouts(spark):
    at = "2026-07-01 00:00:00"
    outbox = spark.createDataFrame(
        [("a", "uploading", 1, "e", None), ("b", "uploading", 30, "e" * 1500, None), ("c", "uploading", 3, "e", 5.0), ("d", "uploaded", 1, "e", None)],
        "chunk_id string, status string, attempts int, last_error string, retry_after_seconds double",
    )
    rows = {r.chunk_id: r for r in ops.retry_schedule(outbox, F.lit(at).cast("timestamp")).collect()}
    assert {k: r.delay_seconds for k, r in rows.items()} == {"a": 30.0, "b": 21600.0, "c": 5.0} and len(rows["b"].last_error) > 1000
    payouts = spark.createDataFrame([("p1", "k", 12500), ("p2", "k", 12500), ("p3", "z", 0), ("p4", "q", 5)], "payout_id string, idempotency_key string, amount_ugx bigint")
    events = spark.createDataFrame(
        [("k", 1, 1, "accepted", "ref"), ("k", 2, 2, "failed", "ref2")], "idempotency_key string, received_at int, event_id int, state string, provider_reference string"
    )
    got = {r.payout_id: (r.state, r.provider_reference, r.duplicates) for r in ops.payout_reconcile(payouts, events).collect()}
    assert got == {"p1": ("accepted", "ref", 1), "p2": ("duplicate", "ref", 1), "p3": ("refused", None, 0), "p4": ("unknown", None, 0)}


def test_access_modes(spark):
    members = spark.createDataFrame([(1, "u", "viewer"), (2, "u", "catalog_editor"), (3, "u", "catalog_admin"), (4, "w", "catalog_admin")], "catalog_id int, user_id string, member_role string")
    sheets = spark.createDataFrame([(i * 10 + j, i, s) for i in (1, 2, 3, 4) for j, s in ((0, "draft"), (1, "active"))], "split_sheet_id int, catalog_id int, status string")
    tables = {"split_sheets": sheets, "royalty_runs": sheets.select(F.col("split_sheet_id").alias("royalty_run_id"), "catalog_id"), "payouts": sheets}
    see = lambda name, mode: sorted(r[0] for r in access.visible_rows(name, tables, members, "u", mode).collect())
    assert see("split_sheets", "read") == [10, 11, 20, 21, 30, 31] and see("split_sheets", "write") == [20, 30, 31]
    assert see("royalty_runs", "read") == [10, 11, 20, 21, 30, 31] and see("royalty_runs", "write") == [] and see("payouts", "read") == []


def test_publish_only_clean_batches(spark, tmp_path):
    lines = spark.createDataFrame([("s", "l1", "p", "r", 10000)], "split_sheet_id string, split_line_id string, party_id string, role string, share_basis_points int")
    sheets = spark.sql(
        "select 's' split_sheet_id, 'c' catalog_id, 'r' recording_id, cast(null as string) work_id, 'master' right_type, 1 version, 'active' status, "
        "date'2024-01-01' valid_from, cast(null as date) valid_to, current_timestamp() approved_at"
    )
    waived = ("sheet_catalog", "usage_links", "allocation_snapshot")
    with pytest.raises(ValueError, match="sheet_catalog"):
        publish({"split_sheets": sheets, "split_lines": lines}, str(tmp_path), "b1", waived[1:])
    assert publish({"split_sheets": sheets, "split_lines": lines}, str(tmp_path), "b1", waived) is None
    with pytest.raises(Exception, match="(?i)exist"):
        publish({"split_sheets": sheets, "split_lines": lines}, str(tmp_path), "b1", waived)
    assert current(spark, str(tmp_path), "split_lines").count() == 1
    found = publish({"split_sheets": sheets, "split_lines": lines.withColumn("share_basis_points", F.lit(9999))}, str(tmp_path), "b2", waived)
    assert [r.rule for r in found.collect()] == ["split_total"]
    assert current(spark, str(tmp_path), "split_lines").first().share_basis_points == 10000
    more = lines.unionByName(lines.withColumns({"split_line_id": F.lit("l2"), "party_id": F.lit("q")})).withColumn("share_basis_points", F.lit(5000))
    assert publish({"split_sheets": sheets, "split_lines": more}, str(tmp_path), "b3", waived) is None
    assert current(spark, str(tmp_path), "split_lines").count() == 2


def test_append_detections_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "idempotency_key string, v int")
    path = str(tmp_path / "d")
    sinks.append_detections(rows, path)
    sinks.append_detections(rows.unionByName(spark.createDataFrame([("c", 3)], rows.schema)), path)
    assert spark.read.parquet(path).count() == 3
