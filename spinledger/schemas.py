"""Fixed schemas of the documents and tables the operators read."""

from __future__ import annotations

LANDMARK = "anchor_frame int, frequency_ratio_bin int, delta_frames int"

MANIFEST = (
    "edge_chunk_id string, source_code string, device_id string, started_at string, ended_at string, "
    "content_sha256 string, byte_count bigint, fingerprint_schema_id string, capture_policy string, "
    "encrypted_object_key string, matcher_hint string, "
    "landmarks array<struct<anchor_frame:int,frequency_ratio_bin:int,delta_frames:int>>"
)
LOG_ENTRIES = (
    "map<string,array<struct<aired_at:string,title:string,artist:string,recording_id:string,"
    "isrc:string,known_catalog:boolean>>>"
)
REVIEWS = "map<string,string>"
CANDIDATES = (
    "map<string,array<struct<recording_id:string,votes:int,confidence_hint:double,tempo_scale:double,"
    "title:string,artist:string>>>"
)
CATALOG = "map<string,struct<title:string,artist:string,isrc:string>>"
SOURCES = (
    "source_code string, display_name string, region string, source_class string, agreed boolean, notes string"
)
MATCH_WINDOWS = (
    "session_id string, track_id string, started_at_seconds double, ended_at_seconds double, confidence double"
)
ONBOARDING = (
    "doc_id string, doc_seq bigint, catalog_name string, owner_local_id string, "
    "organizations array<struct<local_id:string,legal_name:string,organization_type:string,"
    "trading_name:string,registration_number:string,country_code:string,contact_email:string>>, "
    "parties array<struct<local_id:string,party_kind:string,legal_name:string,"
    "organization_local_id:string,stage_or_trading_name:string>>, "
    "works array<struct<local_id:string,title:string,language_code:string,iswc:string,"
    "alternate_titles:array<string>,contributors:array<struct<party_local_id:string,"
    "contributor_role:string,display_order:int>>>>, "
    "releases array<struct<local_id:string,title:string,release_type:string,upc_ean:string>>, "
    "recordings array<struct<local_id:string,title:string,duration_seconds:double,isrc:string,"
    "explicit:boolean,audio_sha256:string,fingerprint_schema_id:string,"
    "artist_credits:array<struct<party_local_id:string,artist_role:string,stage_name:string,"
    "display_order:int,country_code:string>>,work_local_ids:array<string>,"
    "release_local_ids:array<string>,release_track_numbers:map<string,int>>>, "
    "split_sheets array<struct<right_type:string,asset_local_id:string,lines:array<struct<"
    "party_local_id:string,role:string,share_basis_points:int>>,source_document_key:string>>"
)

# The domains of the enumerated columns.
ORGANIZATION_TYPES = (
    "cmo", "label", "publisher", "venue_operator", "broadcaster", "technology_partner", "other",
)
PARTY_KINDS = ("individual", "organization")
ARTIST_ROLES = ("primary", "featured", "remixer", "producer")
CONTRIBUTOR_ROLES = ("composer", "lyricist", "arranger", "publisher", "administrator")
RIGHT_TYPES = ("master", "composition", "performance", "mechanical")
RELEASE_TYPES = ("single", "ep", "album", "compilation", "other")
CAPTURE_POLICIES = ("hashes_only", "encrypted_audio")
SOURCE_CLASSES = ("fm_stream", "online_stream")
SOURCE_TYPES = ("fm_stream", "online_stream", "venue_edge", "vehicle_edge")
LOCATION_TYPES = ("radio_station", "nightclub", "bar", "restaurant", "taxi", "other")
PILOT_REGIONS = ("Gulu", "Jinja", "Kampala", "Mbarara")
CAPTURE_STATES = ("received", "processed", "quarantined", "expired")
DETECTION_STATES = ("candidate", "verified", "rejected", "disputed", "expired")
SHEET_STATES = ("draft", "active", "superseded", "retired")
RUN_STATES = ("draft", "review", "approved", "paid", "cancelled")
WALLET_PROVIDERS = ("mtn_momo", "airtel_money")
ACCOUNT_STATES = ("pending_verification", "active", "suspended", "closed")
PAYOUT_STATES = ("queued", "submitted", "pending", "paid", "failed", "reversed", "held")
REGISTRY_STATES = ("found", "not_found", "ambiguous", "unavailable", "error")
DISPUTE_REASONS = ("wrong_identity", "wrong_duration", "wrong_source", "wrong_split", "duplicate", "other")
DISPUTE_STATES = ("open", "upheld", "dismissed")

BASIS_POINTS = 10_000

# Columns that no shadow report may contain.
FINANCE_WORDS = ("amount", "ugx", "payout", "royalty", "tariff", "settle", "wallet", "payment", "gross")
