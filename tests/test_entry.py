import os
import subprocess
import sys
from pathlib import Path

import __spark_entry__

REPO = Path(__file__).parent.parent


def test_entry_and_names(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_stands_alone(tmp_path):
    """Without the training-data folders and the pipeline, the entry imports and keeps all other queries."""
    for name in ("plumbline", "tests", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(REPO / name), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "plumbline/llm"), str(tmp_path / "tests/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'gap_detection' in q and 'pipeline' not in q and not any(n.startswith('op1') for n in q); print(len(q))"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    some = ["tests/test_operators.py", "tests/test_pd0.py", "-k", "status_order or walks_cover or first_failing"]
    done = subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", *some], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stdout


def test_a_fault_inside_the_folder_shows(tmp_path):
    """Only the folder's absence is let through, not an import that fails."""
    for name in ("plumbline", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(REPO / name), str(tmp_path)], check=True)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module_at_all\n")
    done = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert (done.returncode != 0 and "no_such_module_at_all" in done.stderr) == (tmp_path / "plumbline/llm").is_dir()
