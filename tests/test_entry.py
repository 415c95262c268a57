"""The driver's contract holds with and without the training-data folder."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_rest_imports_without_training_folder():
    code = "import sys; sys.modules['brindle.llm'] = None\nimport __spark_entry__ as e\nassert e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
