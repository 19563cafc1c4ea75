"""All queries of the subpackage."""

from __future__ import annotations

import importlib

from cohortframe.llm.registry import ORACLES, QUERIES

MODULES = ("sharding", "token_output", "ann", "hmm", "chat", "decontaminate", "mixing", "neardup", "pii", "quality", "quality_rules", "whitening", "collocations")
for _name in MODULES:
    importlib.import_module(f"cohortframe.llm.{_name}")


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
