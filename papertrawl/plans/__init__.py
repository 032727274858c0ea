"""Registered queries, by subject."""

from __future__ import annotations

from importlib import import_module

SUBJECTS = ["contacts", "leads", "products", "invoices", "statements", "retrieval", "classify", "ocr", "jobs", "pages"]


def _modules():
    return [import_module(f"papertrawl.plans.{s}") for s in SUBJECTS]


def queries() -> dict:
    return {name: q for m in _modules() for name, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in _modules() for name, sql in m.ORACLES.items()}
