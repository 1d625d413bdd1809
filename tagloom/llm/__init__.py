"""Operators of a training-data pipeline over large text corpora, their queries and oracle SQL."""

from __future__ import annotations

from importlib import import_module

MODULES = ("ngram_join", "quality", "langid", "lines", "idstore", "warc", "tokencount", "mixing", "cosine", "sentencepieces", "urlfilter", "search", "resample")


def queries() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f"tagloom.llm.{m}").QUERIES
    return dict(sorted(out.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict:
    out: dict = {}
    for m in MODULES:
        out |= import_module(f"tagloom.llm.{m}").ORACLE
    return out
