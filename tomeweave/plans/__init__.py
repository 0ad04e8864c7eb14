"""The registered queries, one module per group."""

from __future__ import annotations

from importlib import import_module

GROUPS = ["identifiers", "records", "runs", "texts", "pages", "shops", "artefact_jobs", "matches", "storage", "streams"]


def catalogs():
    return [import_module(f"{__name__}.{group}").catalog for group in GROUPS]
