"""The entry module with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def run(folder, code):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120)


def test_works_without_the_subpackage(tmp_path):
    shutil.copytree(ROOT / "kilnspark", tmp_path / "kilnspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    done = run(tmp_path, "import __spark_entry__ as e; q = e.queries(); assert len(q) > 80 and 'pipeline' not in q and not any(k.startswith('op') for k in q), len(q); assert set(e.oracle_sql()) <= set(q)")
    assert done.returncode == 0, done.stderr


def test_other_import_errors_are_not_hidden(tmp_path):
    shutil.copytree(ROOT / "kilnspark", tmp_path / "kilnspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_library\n")
    done = run(tmp_path, "import __spark_entry__")
    assert done.returncode != 0 and "no_such_library" in done.stderr


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "kilnspark").rglob("*.py"):
        if "llm" not in path.parts:
            assert "kilnspark.llm" not in path.read_text(), path
