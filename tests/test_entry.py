"""The entry point without the corpus subpackage, and with a broken one."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _copy(tmp_path, *left_out):
    shutil.copytree(os.path.join(ROOT, "velonet"), tmp_path / "velonet", ignore=shutil.ignore_patterns("__pycache__", *left_out))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in left_out and os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), sum(k.startswith('op') or k == 'pipeline' for k in q), set(o) <= set(q))"
    return subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_the_rest_stands_alone(tmp_path):
    for i, left_out in enumerate((("llm",), ("llm", "corpus_pipeline.py"))):
        got = _copy(tmp_path / str(i), *left_out)
        total, corpus, same = got.stdout.split()
        assert int(total) > 70 and corpus == "0" and same == "True"


def test_a_missing_dependency_is_not_hidden(tmp_path):
    if not os.path.isdir(os.path.join(ROOT, "velonet", "llm")):
        return
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "public_tokenizers.py").write_text("import no_such_module_anywhere\n")
    code = "import __spark_entry__"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "broken", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": os.pathsep.join([str(tmp_path / "broken"), ROOT])})
    assert got.returncode and "no_such_module_anywhere" in got.stderr
