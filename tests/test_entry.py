"""The driver contract without the training-data folders, and scratch folders on a cluster."""

import shutil
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from swathframe.plans.storage import shared_dir

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture
def without_llm(tmp_path):
    shutil.copytree(ROOT / "swathframe", tmp_path / "swathframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    return tmp_path


def names(folder):
    return subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(*e.queries())"], cwd=folder, capture_output=True, text=True, timeout=120)


def test_entry_without_the_llm_folder(without_llm):
    out = names(without_llm)
    assert out.returncode == 0 and "v12_boxes" in out.stdout.split() and not any(n.startswith("op") or n == "pipeline" for n in out.stdout.split())


def test_entry_does_not_hide_a_broken_llm_folder(without_llm):
    (without_llm / "swathframe/llm").mkdir()
    (without_llm / "swathframe/llm/__init__.py").touch()
    (without_llm / "swathframe/llm/queries.py").write_text("import a_module_that_is_not_there\n")
    out = names(without_llm)
    assert out.returncode and "a_module_that_is_not_there" in out.stderr


def test_no_machine_local_folder_on_a_cluster():
    context = SimpleNamespace(getConf=lambda: {}, getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(sparkContext=context))
    context.getConf = lambda: {"spark.checkpoint.dir": "hdfs://shared/"}
    assert shared_dir(SimpleNamespace(sparkContext=context)) == "hdfs://shared"
