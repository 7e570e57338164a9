"""The entry points, also where the subpackage of corpus operators isn't there."""

import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parents[1]


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_corpus_operators(tmp_path):
    code = "import sys; sys.modules['tracewell.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not [n for n in q if n.startswith('op') or n == 'pipeline']"
    done = subprocess.run([sys.executable, "-c", code], cwd=HERE, capture_output=True, text=True)
    assert not done.returncode, done.stderr
