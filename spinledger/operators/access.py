"""Tenant scoping: which rows of which table a user may read or write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinledger.functions.skew import salted_lookup

# Roles that grant each kind of access; ``None`` means any membership.
ROLES: dict[str, tuple[str, ...] | None] = {
    "read": None,
    "write": ("catalog_editor", "catalog_admin"),
    "admin": ("catalog_admin",),
}
# Tables users may only read, and tables they never see.
READ_ONLY = ("tariff_rates", "royalty_runs", "royalty_usage_items", "royalty_allocations", "audit_events")
HIDDEN = (
    "capture_chunks", "detection_events", "payment_accounts", "payout_batches", "payouts",
    "payout_allocation_items", "payout_outbox", "rights_parties", "edge_nodes",
)
# How a child table reaches the tables that carry ``catalog_id``.
PARENTS: dict[str, tuple[tuple[str, str], ...]] = {
    "release_recordings": (("release_id", "releases"), ("recording_id", "recordings")),
    "recording_artists": (("recording_id", "recordings"),),
    "recording_works": (("recording_id", "recordings"), ("work_id", "music_works")),
    "work_contributors": (("work_id", "music_works"),),
    "split_lines": (("split_sheet_id", "split_sheets"),),
    "royalty_usage_items": (("royalty_run_id", "royalty_runs"),),
    "royalty_allocations": (("usage_item_id", "royalty_usage_items"),),
}


def catalogs_of(members: DataFrame, user_id: object, mode: str) -> DataFrame:
    """The catalogs the user has this access to."""
    mine = members.where(F.col("user_id") == F.lit(user_id))
    roles = ROLES[mode]
    if roles is not None:
        mine = mine.where(F.col("member_role").isin(*roles))
    return mine.select("catalog_id").distinct()


def visible_rows(
    name: str, tables: dict[str, DataFrame], members: DataFrame, user_id: object, mode: str = "read"
) -> DataFrame:
    """The rows of table ``name`` the user may access; every parent must be accessible."""
    rows = tables[name]
    if name in HIDDEN or (mode != "read" and name in READ_ONLY):
        return rows.where(F.lit(False))
    if name in PARENTS:
        for key, parent in PARENTS[name]:
            allowed = visible_rows(parent, tables, members, user_id, mode).select(key)
            rows = salted_lookup(rows, allowed, [key], spread_by=rows.columns[:3], how="left_semi")
        return rows
    if mode == "write" and name == "split_sheets":
        # Editors change drafts only; an administrator changes any sheet.
        editable = _scoped(rows, catalogs_of(members, user_id, "write")).where(F.col("status") == "draft")
        other = _scoped(rows, catalogs_of(members, user_id, "admin")).where(F.col("status") != "draft")
        return editable.unionByName(other)
    if mode == "write" and name in ("catalogs", "catalog_members"):
        mode = "admin"
    return _scoped(rows, catalogs_of(members, user_id, mode))


def _scoped(rows: DataFrame, catalogs: DataFrame) -> DataFrame:
    return salted_lookup(rows, catalogs, ["catalog_id"], spread_by=rows.columns[:3], how="left_semi")
