"""The library works without the training-data operators and their pipeline."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
for name in ("brevis.llm", "corpus_pipeline"):
    sys.modules[name] = None
import __spark_entry__ as entry
names = set(entry.queries())
assert "pack_sentences" in names and "pipeline" not in names
assert not any(n[:2] == "op" and n[2].isdigit() for n in names)
assert set(entry.oracle_sql()) <= names
"""


def test_entry_without_llm():
    subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_llm():
    for top, _, names in os.walk(os.path.join(ROOT, "brevis")):
        if os.path.basename(top) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(top, name)) as f:
                        assert "brevis.llm" not in f.read(), name
