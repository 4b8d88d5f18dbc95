import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_the_rest_registers_without_the_training_data_operators(tmp_path):
    """A copy without the two folders, with and without the pipeline beside the entry, still gives all other queries."""
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", "*.json")
    shutil.copytree(REPO, tmp_path / "copy", ignore=skip)
    script = "from __spark_entry__ import oracle_sql, queries; q = queries(); assert set(oracle_sql()) <= set(q); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q))"
    counts = []
    for pipeline in (True, False):
        if not pipeline:
            (tmp_path / "copy" / "corpus_pipeline.py").unlink(missing_ok=True)
        done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path / "copy", capture_output=True, text=True, timeout=120)
        assert done.returncode == 0, done.stderr[-2000:]
        counts.append(done.stdout.split())
    assert counts[0] == counts[1] and int(counts[0][0]) > 120 and counts[0][1] == "False"
