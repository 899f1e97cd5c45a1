"""The entry point when parts of the repository are missing."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

HIDDEN = """
import importlib.abc, importlib.util, sys
sys.path.insert(0, {root!r})
gone = {gone!r}

class Hide(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if any(name == g or name.startswith(g + ".") for g in gone):
            raise ModuleNotFoundError(name)

real = importlib.util.find_spec
importlib.util.find_spec = lambda name, package=None: None if name in gone else real(name, package)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as entry
names = set(entry.queries())
assert set(entry.oracle_sql()) <= names
print(len(names), sum(n.startswith("op") and n[2].isdigit() for n in names), "pipeline" in names)
"""


@pytest.mark.parametrize("gone", [["observatory.llm"], ["observatory.llm", "corpus_pipeline"], ["corpus_pipeline"]])
def test_entry_imports_without_the_document_operators(gone):
    said = subprocess.run([sys.executable, "-c", HIDDEN.format(root=ROOT, gone=gone)], capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    total, numbered, pipeline = said.stdout.split()
    assert int(total) >= 170 and pipeline == "False"
    there = os.path.exists(os.path.join(ROOT, "observatory", "llm", "__init__.py")) and "observatory.llm" not in gone
    assert (int(numbered) > 0) == there
