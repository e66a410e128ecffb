"""Imports every query module so the catalogue is complete."""

from attesta.plans import queries_core, queries_extract, queries_quality, queries_audit, queries_reports, queries_contracts, queries_versions, queries_evidence  # noqa: F401
from attesta.plans.catalog import ORACLES, QUERIES  # noqa: F401
