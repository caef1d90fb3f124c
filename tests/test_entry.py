import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def names(root):
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(*e.queries()); print(*e.oracle_sql())"], cwd=root, env=os.environ | {"PYTHONPATH": root}, capture_output=True, text=True)
    assert not said.returncode, said.stderr
    queries, sql = (x.split() for x in said.stdout.splitlines()[-2:])
    assert set(sql) <= set(queries)
    return queries


def test_works_without_the_optional_part(tmp_path):
    shutil.copytree(os.path.join(ROOT, "siltstone"), tmp_path / "siltstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    found = names(str(tmp_path))
    assert "dedup_by_lang" in found and not any(n.startswith("op") or n == "pipeline" for n in found)


def test_nothing_else_imports_the_optional_part():
    for folder, _, files in os.walk(os.path.join(ROOT, "siltstone")):
        if os.path.basename(folder) != "llm":
            for f in files:
                if f.endswith(".py"):
                    assert "llm" not in open(os.path.join(folder, f)).read()
