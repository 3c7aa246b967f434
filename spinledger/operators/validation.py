"""Validation of manifests and onboarding documents: every error of a row, not the first.

Documents are nested rows, so all checks, references included, stay inside the row
and need no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spinledger import schemas as S
from spinledger.functions import columns as C

Checks = list[tuple[Column, str | Column]]
MAX_TEXT = 400
MAX_SECONDS = 60 * 60 * 6


def _domain(values: Sequence[str]) -> str:
    return str(sorted(values))


def _timestamp_checks(raw: str, parsed: Column) -> Checks:
    text = F.trim(F.col(raw))
    return [
        (C.is_blank(raw), f"{raw}: required ISO-8601 timestamp"),
        (~C.is_blank(raw) & F.try_to_timestamp(text).isNull(), f"{raw}: invalid ISO-8601 timestamp"),
        (
            F.try_to_timestamp(text).isNotNull() & ~C.has_offset(text),
            f"{raw}: timestamp must include a timezone offset",
        ),
    ]


def landmark_errors(landmarks: str | Column) -> Column:
    """One message per bad landmark, naming its position."""

    def check(mark: Column, i: Column) -> Column:
        where = F.concat(F.lit("landmarks["), i.cast("string"), F.lit("]: "))
        whole = mark.anchor_frame.isNotNull() & mark.frequency_ratio_bin.isNotNull() & mark.delta_frames.isNotNull()
        return (
            F.when(mark.isNull(), F.concat(where, F.lit("expected object")))
            .when(
                ~whole,
                F.concat(where, F.lit("anchor_frame, frequency_ratio_bin and delta_frames must be integers")),
            )
            .when(
                (mark.anchor_frame < 0) | (mark.delta_frames < 1),
                F.concat(where, F.lit("fields out of range (anchor_frame >= 0, delta_frames >= 1)")),
            )
        )

    found = F.filter(F.transform(landmarks, check), lambda m: m.isNotNull())
    return F.coalesce(found, F.array().cast("array<string>"))


def manifest_errors() -> Column:
    policy = F.coalesce("capture_policy", F.lit("hashes_only"))
    known = policy.isin(*S.CAPTURE_POLICIES)
    effective = F.when(known, policy).otherwise("hashes_only")
    key = F.when(~C.is_blank("encrypted_object_key"), F.col("encrypted_object_key"))
    started = C.parse_timestamp("started_at", naive="error")
    ended = C.parse_timestamp("ended_at", naive="error")
    required = "required non-empty string"
    checks: Checks = [
        (C.is_blank("edge_chunk_id"), f"edge_chunk_id: {required}"),
        (
            ~C.is_blank("edge_chunk_id") & ~F.trim("edge_chunk_id").rlike(C.UUID_PATTERN),
            "edge_chunk_id: must be a UUID",
        ),
        (C.is_blank("source_code"), f"source_code: {required}"),
        *_timestamp_checks("started_at", started),
        *_timestamp_checks("ended_at", ended),
        (ended <= started, "ended_at must be after started_at"),
        (C.is_blank("content_sha256"), f"content_sha256: {required}"),
        (
            ~C.is_blank("content_sha256") & ~F.trim("content_sha256").rlike(C.SHA256_PATTERN),
            "content_sha256: expected 64 lowercase hex characters",
        ),
        (
            F.col("byte_count").isNull() | (F.col("byte_count") < 0),
            "byte_count: required non-negative integer",
        ),
        (C.is_blank("fingerprint_schema_id"), f"fingerprint_schema_id: {required}"),
        (~known, f"capture_policy: must be one of {_domain(S.CAPTURE_POLICIES)}"),
        (
            F.col("encrypted_object_key").isNotNull() & C.is_blank("encrypted_object_key"),
            "encrypted_object_key: must be a non-empty string when provided",
        ),
        (
            (effective == "hashes_only") & key.isNotNull(),
            "encrypted_object_key is not permitted under the hashes_only policy",
        ),
        (
            (effective == "encrypted_audio") & key.isNull(),
            "encrypted_audio policy requires an encrypted_object_key",
        ),
    ]
    return F.concat(C.error_list(*checks), landmark_errors("landmarks"))


def validate_manifests(manifests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid manifests with trimmed text and parsed times, rejected ones with ``errors``)."""
    checked = manifests.withColumn("errors", manifest_errors())
    rejected = checked.where(F.size("errors") > 0)
    text = ["edge_chunk_id", "source_code", "content_sha256", "fingerprint_schema_id"]
    valid = checked.where(F.size("errors") == 0).withColumns(
        {
            **{c: F.trim(c) for c in text},
            "started_at": C.parse_timestamp("started_at", naive="error"),
            "ended_at": C.parse_timestamp("ended_at", naive="error"),
            "capture_policy": F.coalesce("capture_policy", F.lit("hashes_only")),
            "landmarks": F.coalesce("landmarks", F.array().cast(manifests.schema["landmarks"].dataType)),
        }
    )
    return valid.drop("errors"), rejected


def with_report_device(manifests: DataFrame) -> DataFrame:
    """The report path's device: its own id, else the source, else a constant."""
    named = lambda c: F.when(F.col(c) != "", F.col(c))
    return manifests.withColumn(
        "device_id", F.coalesce(named("device_id"), named("source_code"), F.lit("shadow-runner"))
    )


def schema_compatible(chunks: DataFrame, schema_id: str) -> DataFrame:
    return chunks.withColumn("schema_compatible", F.col("fingerprint_schema_id").eqNullSafe(F.lit(schema_id)))


# Onboarding documents ---------------------------------------------------------------


def _required(item: Column, field: str, label: str) -> Checks:
    value = item[field]
    return [
        (C.is_blank(value), f"{label}: required non-empty string"),
        (F.length(F.trim(value)) > MAX_TEXT, f"{label}: exceeds {MAX_TEXT} characters"),
    ]


def _optional(item: Column, field: str, label: str) -> Checks:
    value = item[field]
    return [(value.isNotNull() & C.is_blank(value), f"{label}: must be a non-empty string when provided")]


def _in_domain(item: Column, field: str, label: str, values: Sequence[str]) -> Checks:
    text = F.trim(item[field])
    message = F.concat(F.lit(f"{label}: '"), text, F.lit(f"' not in {_domain(values)}"))
    return [(~C.is_blank(text) & ~text.isin(*values), message)]


def _positive_order(item: Column, label: str) -> Checks:
    return [(F.coalesce(item["display_order"], F.lit(1)) < 1, f"{label}: positive integer required")]


def _country(item: Column, message: str) -> Checks:
    return [(~F.coalesce(item["country_code"], F.lit("UG")).rlike(C.COUNTRY_PATTERN), message)]


def _organization(o: Column) -> Column:
    p = "organization"
    bad_email = ~o["contact_email"].rlike(C.EMAIL_PATTERN) | (F.length(o["contact_email"]) > 254)
    return C.error_list(
        *_required(o, "local_id", f"{p}.local_id"),
        *_required(o, "legal_name", f"{p}.legal_name"),
        *_required(o, "organization_type", f"{p}.organization_type"),
        *_in_domain(o, "organization_type", f"{p}.organization_type", S.ORGANIZATION_TYPES),
        *_country(o, f"{p}.country_code: expected ISO-3166 alpha-2, e.g. 'UG'"),
        (bad_email, f"{p}.contact_email: invalid email address"),
        *_optional(o, "trading_name", f"{p}.trading_name"),
        *_optional(o, "registration_number", f"{p}.registration_number"),
    )


def _party(y: Column, organization_ids: Column) -> Column:
    link = F.trim(y["organization_local_id"])
    label = "party.organization_local_id"
    return C.error_list(
        *_required(y, "local_id", "party.local_id"),
        *_required(y, "legal_name", "party.legal_name"),
        *_required(y, "party_kind", "party.party_kind"),
        *_in_domain(y, "party_kind", "party.party_kind", S.PARTY_KINDS),
        (link.isNotNull() & (link == ""), f"{label}: required non-empty string"),
        (
            ~C.is_blank(link) & ~F.array_contains(organization_ids, link),
            F.concat(F.lit(f"{label}: unknown organization '"), link, F.lit("'")),
        ),
        (
            (F.trim(y["party_kind"]) == "individual") & ~C.is_blank(link),
            f"{label}: individual parties must not link an organization",
        ),
        (
            (F.trim(y["party_kind"]) == "organization") & C.is_blank(link),
            f"{label}: organization parties must link an organization",
        ),
        *_optional(y, "stage_or_trading_name", "party.stage_or_trading_name"),
    )


def _contributor(c: Column) -> Column:
    p = "contributor"
    return C.error_list(
        *_required(c, "party_local_id", f"{p}.party_local_id"),
        *_required(c, "contributor_role", f"{p}.contributor_role"),
        *_in_domain(c, "contributor_role", f"{p}.contributor_role", S.CONTRIBUTOR_ROLES),
        *_positive_order(c, f"{p}.display_order"),
    )


def _work(w: Column) -> Column:
    language = F.coalesce(w["language_code"], F.lit("und"))
    return F.concat(
        C.error_list(
            *_required(w, "local_id", "work.local_id"),
            *_required(w, "title", "work.title"),
            (
                ~language.rlike(C.LANGUAGE_PATTERN),
                "work.language_code: expected ISO-639-3 code, e.g. 'lug' or 'und'",
            ),
            *_optional(w, "iswc", "work.iswc"),
            (
                ~C.is_blank(w["iswc"]) & C.normalize_iswc(w["iswc"]).isNull(),
                F.concat(F.lit("work.iswc: '"), F.trim(w["iswc"]), F.lit("' is not a valid ISWC (T-xxx.xxx.xxx-x)")),
            ),
            (
                F.exists(_list(w["alternate_titles"], "array<string>"), C.is_blank),
                "work.alternate_titles: expected array of non-empty strings",
            ),
        ),
        _each(w["contributors"], _contributor),
    )


def _release(r: Column) -> Column:
    kind = F.coalesce(r["release_type"], F.lit("single"))
    return C.error_list(
        *_required(r, "local_id", "release.local_id"),
        *_required(r, "title", "release.title"),
        (
            ~kind.isin(*S.RELEASE_TYPES),
            F.concat(F.lit("release.release_type: '"), kind, F.lit(f"' not in {_domain(S.RELEASE_TYPES)}")),
        ),
        *_optional(r, "upc_ean", "release.upc_ean"),
        (
            ~C.is_blank(r["upc_ean"]) & ~F.trim(r["upc_ean"]).rlike(C.UPC_PATTERN),
            "release.upc_ean: expected 8–14 digits",
        ),
    )


def _credit(c: Column) -> Column:
    p = "artist_credit"
    return C.error_list(
        *_required(c, "party_local_id", f"{p}.party_local_id"),
        *_required(c, "artist_role", f"{p}.artist_role"),
        *_in_domain(c, "artist_role", f"{p}.artist_role", S.ARTIST_ROLES),
        *_required(c, "stage_name", f"{p}.stage_name"),
        *_positive_order(c, f"{p}.display_order"),
        *_country(c, f"{p}.country_code: expected ISO-3166 alpha-2"),
    )


def _recording(r: Column) -> Column:
    seconds = r["duration_seconds"]
    p = "recording"
    return F.concat(
        C.error_list(
            *_required(r, "local_id", f"{p}.local_id"),
            *_required(r, "title", f"{p}.title"),
            (
                seconds.isNull() | F.isnan(seconds) | (seconds <= 0) | (seconds > MAX_SECONDS),
                f"{p}.duration_seconds: positive number of seconds (max 6h) required",
            ),
            *_optional(r, "isrc", f"{p}.isrc"),
            (
                ~C.is_blank(r["isrc"]) & C.normalize_isrc(r["isrc"]).isNull(),
                F.concat(F.lit(f"{p}.isrc: '"), F.trim(r["isrc"]), F.lit("' is not a valid 12-character ISRC")),
            ),
            *_optional(r, "audio_sha256", f"{p}.audio_sha256"),
            (
                ~C.is_blank(r["audio_sha256"]) & ~F.lower(F.trim(r["audio_sha256"])).rlike(C.SHA256_PATTERN),
                f"{p}.audio_sha256: expected 64 lowercase hex characters",
            ),
            *_optional(r, "fingerprint_schema_id", f"{p}.fingerprint_schema_id"),
        ),
        _each(r["artist_credits"], _credit),
        C.error_list(
            (
                F.exists(_list(r["work_local_ids"], "array<string>"), C.is_blank),
                f"{p}.work_local_ids: expected array of local ids",
            ),
            (
                F.exists(_list(r["release_local_ids"], "array<string>"), C.is_blank),
                f"{p}.release_local_ids: expected array of local ids",
            ),
        ),
    )


def _split_sheet(s: Column) -> Column:
    def line(x: Column, i: Column) -> Column:
        at = F.concat(F.lit("split_sheet.lines["), i.cast("string"), F.lit("]."))
        share = x["share_basis_points"]
        return C.error_list(
            (C.is_blank(x["party_local_id"]), F.concat(at, F.lit("party_local_id: required non-empty string"))),
            (C.is_blank(x["role"]), F.concat(at, F.lit("role: required non-empty string"))),
            (
                share.isNull() | (share <= 0) | (share > S.BASIS_POINTS),
                F.concat(at, F.lit(f"share_basis_points: integer in 1..{S.BASIS_POINTS} required")),
            ),
        )

    return F.concat(
        C.error_list(
            *_required(s, "right_type", "split_sheet.right_type"),
            *_in_domain(s, "right_type", "split_sheet.right_type", S.RIGHT_TYPES),
            *_required(s, "asset_local_id", "split_sheet.asset_local_id"),
            (
                F.coalesce(F.size(s["lines"]), F.lit(0)) <= 0,
                "split_sheet.lines: at least one split line is required",
            ),
        ),
        F.coalesce(F.flatten(F.transform(s["lines"], line)), F.array().cast("array<string>")),
        C.error_list(*_optional(s, "source_document_key", "split_sheet.source_document_key")),
    )


def _list(value: Column, kind: str) -> Column:
    return F.coalesce(value, F.array().cast(kind))


def _each(items: str | Column, check: object) -> Column:
    """All messages of all items; no items, no messages."""
    return F.coalesce(F.flatten(F.transform(items, check)), F.array().cast("array<string>"))


def _ids(items: str) -> Column:
    """The usable local ids of a collection, in order."""
    ids = F.transform(items, lambda x: F.trim(x["local_id"]))
    return F.coalesce(F.filter(ids, lambda v: ~C.is_blank(v)), F.array().cast("array<string>"))


def _duplicated(ids: str) -> Column:
    return F.size(F.array_distinct(ids)) != F.size(ids)


def reference_errors() -> Column:
    """Local ids that resolve to nothing inside their own document."""

    def of_recording(r: Column) -> Column:
        head = F.concat(F.lit("recording '"), F.trim(r["local_id"]), F.lit("': "))
        quoted = lambda text, v: F.concat(head, F.lit(f"{text} '"), v, F.lit("'"))
        absent = lambda pool: lambda v: ~F.array_contains(pool, v)
        parties = F.filter(F.transform(r["artist_credits"], lambda c: F.trim(c["party_local_id"])), lambda v: ~C.is_blank(v))
        numbers = F.transform(r["release_local_ids"], lambda k: F.try_element_at(r["release_track_numbers"], k))
        none = F.array().cast("array<string>")
        return F.concat(
            F.coalesce(
                F.transform(
                    F.filter(parties, absent(F.col("_parties"))),
                    lambda v: quoted("artist credit references unknown party", v),
                ),
                none,
            ),
            F.coalesce(
                F.transform(F.filter(r["work_local_ids"], absent(F.col("_works"))), lambda v: quoted("unknown work_local_id", v)),
                none,
            ),
            F.coalesce(
                F.transform(
                    F.filter(r["release_local_ids"], absent(F.col("_releases"))),
                    lambda v: quoted("unknown release_local_id", v),
                ),
                none,
            ),
            F.coalesce(
                F.transform(
                    F.filter(numbers, lambda n: n < 1),
                    lambda n: F.concat(head, F.lit("release_track_numbers must be positive")),
                ),
                none,
            ),
        )

    def of_work(w: Column) -> Column:
        parties = F.transform(w["contributors"], lambda c: F.trim(c["party_local_id"]))
        lost = F.filter(parties, lambda v: ~C.is_blank(v) & ~F.array_contains(F.col("_parties"), v))
        found = F.transform(
            lost,
            lambda v: F.concat(
                F.lit("work '"), F.trim(w["local_id"]), F.lit("': contributor references unknown party '"), v, F.lit("'")
            ),
        )
        return F.coalesce(found, F.array().cast("array<string>"))

    owner = F.trim("owner_local_id")
    return F.concat(
        C.error_list(
            (
                ~C.is_blank("owner_local_id") & ~F.array_contains("_organizations", owner),
                "owner_local_id: must reference an organization in this submission",
            )
        ),
        _each("recordings", of_recording),
        _each("works", of_work),
    )


def split_sheet_errors() -> Column:
    """Assets, duplicate sheets, parties and totals of a document's draft sheets."""
    right = lambda s: F.coalesce(F.when(~C.is_blank(s["right_type"]), F.trim(s["right_type"])), F.lit("master"))
    asset = lambda s: F.coalesce(F.trim(s["asset_local_id"]), F.lit(""))
    keys = F.transform("split_sheets", lambda s: F.struct(right(s), asset(s)))

    def check(s: Column, i: Column) -> Column:
        head = F.concat(F.lit("split_sheets["), i.cast("string"), F.lit("]: "))
        master = right(s) == "master"
        pool = F.when(master, F.col("_recordings")).otherwise(F.col("_works"))
        kind = F.when(master, "recording").otherwise("work")
        parties = F.filter(F.transform(s["lines"], lambda x: F.trim(x["party_local_id"])), lambda v: ~C.is_blank(v))
        total = F.aggregate(
            F.transform(
                s["lines"],
                lambda x: F.when(x["share_basis_points"].between(1, S.BASIS_POINTS), x["share_basis_points"]).otherwise(0),
            ),
            F.lit(0),
            lambda a, x: a + x,
        )
        lost = F.filter(parties, lambda v: ~F.array_contains(F.col("_parties"), v))
        none = F.array().cast("array<string>")
        return F.concat(
            C.error_list(
                (
                    ~F.array_contains(pool, asset(s)),
                    F.concat(
                        head, F.lit("asset_local_id '"), asset(s), F.lit("' is not a "), kind, F.lit(" in this submission")
                    ),
                ),
                (
                    F.array_position(keys, F.struct(right(s), asset(s))) <= i,
                    F.concat(head, F.lit("duplicate "), right(s), F.lit(" sheet for asset")),
                ),
            ),
            F.coalesce(
                F.transform(lost, lambda v: F.concat(head, F.lit("split line references unknown party '"), v, F.lit("'"))),
                none,
            ),
            C.error_list(
                (
                    F.size(F.array_distinct(parties)) != F.size(parties),
                    F.concat(head, F.lit("a party appears more than once on the sheet")),
                ),
                (
                    total > S.BASIS_POINTS,
                    F.concat(
                        head,
                        F.lit("lines total "),
                        total.cast("string"),
                        F.lit(f" basis points, exceeding {S.BASIS_POINTS} (100%)"),
                    ),
                ),
            ),
        )

    return _each("split_sheets", check)


def validate_onboarding(docs: DataFrame) -> DataFrame:
    """Documents with the full list of their errors."""
    collections = ("organizations", "parties", "works", "releases", "recordings")
    with_ids = docs.withColumns({f"_{c}": _ids(c) for c in collections})
    duplicate = lambda c: C.error_list((_duplicated(f"_{c}"), f"{c}: duplicate local_id"))
    document = F.struct("catalog_name", "owner_local_id")
    errors = F.concat(
        C.error_list(
            *_required(document, "catalog_name", "catalog_name"),
            *_required(document, "owner_local_id", "owner_local_id"),
        ),
        _each("organizations", _organization),
        duplicate("organizations"),
        _each("parties", lambda y: _party(y, F.col("_organizations"))),
        duplicate("parties"),
        _each("works", _work),
        duplicate("works"),
        _each("releases", _release),
        duplicate("releases"),
        _each("recordings", _recording),
        duplicate("recordings"),
        reference_errors(),
        _each("split_sheets", _split_sheet),
        split_sheet_errors(),
    )
    return with_ids.withColumn("errors", errors).drop(*[f"_{c}" for c in collections])
