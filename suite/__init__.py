"""Registered queries over the driver's tables, each with its SQL oracle."""

from suite import (  # noqa: F401
    q_audits,
    q_catalog,
    q_features,
    q_lifecycle,
    q_matching,
    q_reconciliation,
    q_royalty,
    q_segmentation,
    q_streams,
)
from suite.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
