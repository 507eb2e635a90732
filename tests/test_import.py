import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_registry_needs_no_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr[-2000:]
    queries, oracles = map(int, said.stdout.split())
    assert queries > oracles > 50
