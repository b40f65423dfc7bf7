"""The entry without the optional folders: every other query is still there."""

import json
import os
import shutil
import subprocess
import sys

import pytest

from lexatlas.plans import catalog

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("pipeline_file_stays", [True, False])
def test_entry_without_optional_folders(tmp_path, pipeline_file_stays):
    gone = {"lexatlas": ["llm"], "tests": ["llm"], ".": [] if pipeline_file_stays else ["corpus_pipeline.py"]}
    shutil.copytree(ROOT, tmp_path / "tree", ignore=lambda folder, names: [".git", "__pycache__", *gone.get(os.path.relpath(folder, ROOT), [])])
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    made = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "tree", env=environment, capture_output=True, text=True, timeout=120)
    assert made.returncode == 0, made.stderr
    catalog.load()
    assert json.loads(made.stdout) == [sorted(catalog.QUERIES), sorted(catalog.SQL)]
