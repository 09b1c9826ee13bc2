import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent
WITHOUT = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("factlane.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in e.queries()))
"""


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 50


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_corpus_operators():
    out = subprocess.run([sys.executable, "-c", WITHOUT], cwd=ROOT, capture_output=True, text=True, timeout=60, check=True).stdout.split()
    assert int(out[0]) > 50 and int(out[1]) > 25 and out[2] == "False"


def test_nothing_imports_the_corpus_operators():
    for p in (ROOT / "factlane").rglob("*.py"):
        if "llm" not in p.parts:
            assert "factlane.llm" not in p.read_text() and "from ..llm" not in p.read_text(), p
