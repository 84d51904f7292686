"""The entry point where optional parts are left out."""

import os
import shutil
import subprocess
import sys

from conftest import ROOT

LIST = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), any(n[:2] == 'op' and n[2].isdigit() for n in q))"


def listed(folder, *before):
    env = os.environ | {"PYTHONPATH": str(folder), "PYTHONDONTWRITEBYTECODE": "1"}
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", "; ".join([*before, LIST])], cwd=folder, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()


def test_queries_without_the_optional_parts(tmp_path):
    """Without the llm folders (and with a pipeline that needs them), and with one of their dependencies missing."""
    from cargolens.plans import registry
    names = [str(len(registry.queries())), str(len(registry.oracle_sql())), "False"]
    shutil.copytree(os.path.join(ROOT, "cargolens"), tmp_path / "cargolens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("from cargolens.llm import bpe\n")
    assert listed(tmp_path) == names
    if os.path.isdir(os.path.join(ROOT, "cargolens", "llm")):
        assert listed(ROOT, "import sys", "sys.modules['numpy'] = None") == names
