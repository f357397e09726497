"""The driver contract with and without the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).parent.parent


def names(folder, env="pass"):
    code = f"{env}; import __spark_entry__ as e; print(*e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)
    return done.stdout.split() if done.returncode == 0 else done.stderr


def test_the_rest_stands_alone(tmp_path):
    left_out = shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__")
    shutil.copytree(REPO, tmp_path / "rest", ignore=left_out)
    found = names(tmp_path / "rest")
    assert "hub_customer_initial" in found and not any(n.startswith("op") or n == "pipeline" for n in found)


def test_nothing_else_imports_the_operators():
    for path in [*REPO.glob("siltstone/**/*.py"), *REPO.glob("tests/*.py"), REPO / "bench.py"]:
        if "llm" not in path.relative_to(REPO).parts and path.name != "test_entry.py":
            assert "siltstone.llm" not in path.read_text() and "corpus_pipeline" not in path.read_text(), path


def test_a_broken_operator_is_an_error_not_absent(tmp_path):
    if not (REPO / "siltstone" / "llm").exists():
        return
    found = names(REPO, "import sys; sys.modules['xxhash'] = None")
    assert "ModuleNotFoundError" in found or "ImportError" in found
