"""The driver contract: queries and SQL belong together, every query reads the given tables, and the rest works without the llm subpackage."""

import importlib
import pathlib
import re
import sys

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_contract():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert {"p1_found", "p2_found", "p4_found", "hub_nodes"} <= names


@pytest.mark.parametrize("name", ["graph_stats", "p2_found", "node_degree"])
def test_queries_read_the_given_tables(spark, name):
    files = entry.queries()[name](spark, SMALL).inputFiles()
    assert files and all(f.startswith("file:") for f in files)


def test_entry_works_without_the_llm_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "weftmark.llm.queries", None)  # an import of it now fails
    names = set(entry.queries())
    assert "p1_found" in names and "p5_found" not in names and "p6_ids" not in names
    assert set(entry.oracle_sql()) <= names


def test_nothing_else_imports_the_llm_subpackage():
    root = pathlib.Path(importlib.import_module("weftmark").__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert not re.search(r"^\s*(?:from|import)\s+\S*llm", path.read_text(), re.M), path
