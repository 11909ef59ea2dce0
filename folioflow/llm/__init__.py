"""Training-data operators. Nothing outside this package imports it; it uses only the core's session and scans.

queries() and oracle_sql() gather the pN_ queries of its modules for the driver's entry file.
"""

from __future__ import annotations

from importlib import import_module

MODULES = ("same_look", "repeated_lines", "scan_noise", "sentence_units", "wrong_encoding", "broken_pairs", "bpe_encode", "fill_containers", "split_texts")


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f"{__name__}.{m}").QUERIES
    return out


def oracle_sql() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(import_module(f"{__name__}.{m}"), "ORACLE", {})
    return out
