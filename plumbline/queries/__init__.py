"""Registered queries of the analytics operators."""

from __future__ import annotations

from plumbline.queries.base import QUERIES, SQL


def _load() -> None:
    from plumbline.queries import corpora, graph, metrics, models, service, tables, text  # noqa: F401


_load()
__all__ = ["QUERIES", "SQL"]
