"""The entry point with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), 'pipeline' in q, any(n.startswith('op') and n[2].isdigit() for n in q))"


def names(at):
    out = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=at, env={**os.environ, "PYTHONPATH": at}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_without_llm(tmp_path):
    shutil.copytree(f"{ROOT}/corpusloom", tmp_path / "corpusloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    some = names(str(tmp_path))
    assert int(some[0]) > 100 and some[1:] == ["False", "False"]


def test_nothing_else_uses_llm():
    for folder, _, files in os.walk(f"{ROOT}/corpusloom"):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as text:
                        assert "llm" not in [w for line in text if "import" in line for w in line.replace(".", " ").split()], f
