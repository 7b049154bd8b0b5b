import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.columns == ["qid", "rk", "vec_id", "dist"] and df.count() > 0


@pytest.mark.parametrize("pipeline_stays", [False, True])
def test_works_without_the_training_data_operators(tmp_path, pipeline_stays):
    """Both folders deleted, corpus_pipeline.py deleted with them or left in place."""
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    if pipeline_stays and os.path.exists(f"{ROOT}/corpus_pipeline.py"):
        shutil.copy(f"{ROOT}/corpus_pipeline.py", tmp_path)
    shutil.copytree(f"{ROOT}/lodestar", tmp_path / "lodestar", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') for n in q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    n, has_op, has_pipeline, covered = out.stdout.split()
    assert int(n) > 30 and has_op == has_pipeline == "False" and covered == "True"


def test_errors_inside_are_not_hidden(tmp_path):
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{ROOT}/lodestar", tmp_path / "lodestar", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    (tmp_path / "lodestar" / "llm").mkdir()
    (tmp_path / "lodestar" / "llm" / "__init__.py").write_text("")
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert "no_such_module" in out.stderr
