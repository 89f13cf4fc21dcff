"""The entry file with and without the folders of the training-data operators."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SHOW = "import __spark_entry__ as e; print(*sorted(e.queries()))"


@pytest.mark.parametrize("left", ["nothing", "cache", "broken"])
def test_without_the_folders(tmp_path, left):
    """Own queries stay, whether or not a cache is left; an error inside the folder is no removed folder."""
    skip = shutil.ignore_patterns("__pycache__", *([] if left == "broken" else ["llm"]))
    shutil.copytree(ROOT / "modlens", tmp_path / "modlens", ignore=skip)
    for name in ("__spark_entry__.py", "oracle.py", *(["corpus_pipeline.py"] if left == "broken" else [])):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    if left == "cache":
        (tmp_path / "modlens" / "llm" / "__pycache__").mkdir(parents=True)
    if left == "broken":
        if not (tmp_path / "modlens" / "llm").exists():
            pytest.skip("the folder is not there")
        (tmp_path / "modlens" / "llm" / "queries.py").write_text("from modlens.llm import no_such_name\n")
    done = subprocess.run([sys.executable, "-c", SHOW], cwd=tmp_path, capture_output=True, text=True, timeout=100)
    if left == "broken":
        assert done.returncode and "no_such_name" in done.stderr
    else:
        names = done.stdout.split()
        assert "module_index" in names and not [n for n in names if n.startswith("op") or n == "pipeline"]
