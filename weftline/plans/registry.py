"""All queries of the reference's own operators, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES: tuple[str, ...] = ("corpus", "rollouts", "scores", "dialogues", "tables", "online", "further", "closing", "graded", "samples", "toolcases", "hooked", "io", "entries")


def _all(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        for key, value in getattr(import_module(f"weftline.plans.{name}"), what).items():
            if key in found:
                raise ValueError(f"two queries are named {key}")
            found[key] = value
    return found


def queries() -> dict[str, Callable]:
    return _all("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _all("SQL")
