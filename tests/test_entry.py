"""The entry module with and without the corpus operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def _names(block: str) -> set[str]:
    code = f"import sys\n{block}\nimport __spark_entry__ as e\nassert set(e.oracle_sql()) <= set(e.queries())\nprint(*e.queries())"
    return set(subprocess.run([sys.executable, "-B", "-c", code], cwd=ROOT, capture_output=True, text=True, check=True, timeout=120).stdout.split())


def test_imports_without_corpus_operators():
    names = _names("sys.modules['geostream.llm'] = None")
    assert "velocity_segments" in names and not any(n.startswith("op") or n == "pipeline" for n in names)


def test_nothing_else_imports_corpus_operators():
    for path in (ROOT / "geostream").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text()


def test_flagship(spark):
    import __spark_entry__

    if (Path("/root/testdata/sf0.001")).is_dir():
        df = __spark_entry__.entry(spark)
        assert df.count() > 0 and "ve_mm_yr" in df.columns
