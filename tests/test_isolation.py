"""The library without the folder of the training-data operators."""

import os
import re
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def names(folder):
    run = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, check=False)
    return [set(x.split()) for x in run.stdout.splitlines()] if run.returncode == 0 else run.stderr


def test_nothing_else_imports_the_folder():
    files = [p for p in [*ROOT.glob("*.py"), *(ROOT / "tessera").rglob("*.py")] if "llm" not in p.parts and p.name not in ("__spark_entry__.py", "corpus_pipeline.py")]
    assert len(files) > 10 and not [p for p in files if re.search(r"^\s*(from|import) .*(\bllm\b|corpus_pipeline)", p.read_text(), re.M)]


def test_without_the_folder(tmp_path):
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    found = names(tmp_path)
    assert "q22" in found[0] and found[1] <= found[0] and not [n for n in found[0] if n.startswith("op") or n == "pipeline"]
    (tmp_path / "tessera/llm/__pycache__").mkdir(parents=True)  # what may be left of it
    assert names(tmp_path) == found


def test_an_error_inside_the_folder_shows(tmp_path):
    shutil.copytree(ROOT / "tessera", tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "tessera/llm").mkdir()
    (tmp_path / "tessera/llm/__init__.py").touch()
    (tmp_path / "tessera/llm/queries.py").write_text("import a_module_that_is_nowhere\n")
    assert "a_module_that_is_nowhere" in names(tmp_path)
