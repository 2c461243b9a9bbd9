"""The entry point stands on its own: it imports, and lists its queries, where the optional parts are not there."""

import json
import os
import shutil
import subprocess
import sys

from conftest import ROOT


def _names(root):
    code = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=root, capture_output=True, text=True, check=True,
                         env=os.environ | {"PYTHONPATH": root})
    return json.loads(out.stdout)


def test_without_the_optional_parts(tmp_path):
    from rigscope.plans.catalog import REGISTRY

    bare = tmp_path / "bare"
    shutil.copytree(ROOT, bare, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    queries, oracles = _names(str(bare))
    assert queries == sorted(REGISTRY) and set(oracles) == {n for n, (_, text, _) in REGISTRY.items() if text}


def test_a_missing_library_leaves_the_other_queries(tmp_path):
    from rigscope.plans.catalog import REGISTRY

    broken = tmp_path / "broken"
    shutil.copytree(ROOT, broken, ignore=shutil.ignore_patterns(".git", "llm", "__pycache__"))
    (broken / "rigscope" / "llm").mkdir()
    (broken / "rigscope" / "llm" / "queries.py").write_text("import no_such_module_anywhere\n")
    code = "import json, __spark_entry__ as e; print(json.dumps(sorted(e.queries())))"
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=broken, capture_output=True, text=True,
                         env=os.environ | {"PYTHONPATH": str(broken)}, check=True)
    assert json.loads(run.stdout) == sorted(REGISTRY)
    assert "no_such_module_anywhere" in run.stderr
