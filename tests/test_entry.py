"""The driver's entry in a copy of the repository without the optional parts."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import __spark_entry__ as e
names, sql = e.queries(), e.oracle_sql()
assert "g5_stop_metrics" in names and "pipeline" not in names and not [n for n in names if n.startswith("op1")], sorted(names)
assert set(sql) <= set(names)
print(len(names))
"""


def test_entry_without_the_optional_folders(tmp_path):
    for name in ("kerbflow", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    paths = [p for p in sys.path if p and not os.path.exists(os.path.join(p, "kerbflow"))]
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env={**env, "PYTHONPATH": os.pathsep.join(paths)},
                          capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) >= 138
