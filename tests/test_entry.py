"""The entry with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(set(o) - set(q)), any(k.startswith('op') and k[2].isdigit() for k in q), 'pipeline' in q)"


def asked(folder):
    return subprocess.run([sys.executable, "-B", "-c", ASK], cwd=folder, env={"PYTHONPATH": str(folder), "PATH": ""}, capture_output=True, text=True)


def copied(to, *left_out):
    shutil.copytree(REPO / "usagelens", to / "usagelens", ignore=shutil.ignore_patterns("__pycache__", *left_out))
    shutil.copy(REPO / "__spark_entry__.py", to)


def test_without_the_operators(tmp_path):
    copied(tmp_path, "llm")
    n, unknown, operators, pipeline = asked(tmp_path).stdout.split()
    assert int(n) > 90 and (unknown, operators, pipeline) == ("0", "False", "False")


def test_a_fault_in_the_operators_is_no_absence(tmp_path):
    copied(tmp_path, "llm")
    (tmp_path / "usagelens" / "llm").mkdir()
    (tmp_path / "usagelens" / "llm" / "__init__.py").write_text("")
    (tmp_path / "corpus_pipeline.py").write_text("from usagelens.llm import gone\n")
    assert "ImportError" in asked(tmp_path).stderr
    (tmp_path / "corpus_pipeline.py").write_text("import a_package_that_is_not_there\n")
    assert "ModuleNotFoundError" in asked(tmp_path).stderr
