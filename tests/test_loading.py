"""The registry loads wherever PySpark comes from: the installed package, the
zip that spark-submit and the Python workers use, and inside a worker."""

import os
import shutil
import subprocess
import sys

import pyspark
import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert set(s) <= set(q); print(len(q), len(s))"


def _listed(folder: str, paths: list[str]) -> list[int]:
    env = dict(os.environ, PYTHONPATH=os.pathsep.join(paths))
    out = subprocess.run([sys.executable, "-c", LIST], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    return [int(n) for n in out.stdout.split()]


def _zips() -> list[str]:
    lib = os.path.join(os.path.dirname(pyspark.__file__), "python", "lib")
    found = sorted(os.path.join(lib, f) for f in os.listdir(lib) if f.endswith(".zip"))
    assert any("pyspark" in os.path.basename(f) for f in found)
    return found


def test_queries_from_installed_package_and_from_zip():
    plain = _listed(REPO, [REPO])
    assert plain[0] > 100 and plain[1] > 90
    assert _listed(REPO, [*_zips(), REPO]) == plain


def test_queries_from_zipped_library(tmp_path):
    """The library itself in a zip, as --py-files ships it."""
    shutil.copytree(os.path.join(REPO, "mailsift"), tmp_path / "src" / "mailsift", ignore=shutil.ignore_patterns("__pycache__"))
    packed = shutil.make_archive(str(tmp_path / "mailsift"), "zip", tmp_path / "src")
    code = "from mailsift.plans import registry; print(len(registry.queries()), len(registry.oracle_sql()))"
    env = dict(os.environ, PYTHONPATH=os.pathsep.join([*_zips(), packed]))
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr
    assert int(out.stdout.split()[0]) > 100


def test_registry_loads_in_a_worker(spark):
    def count(batches):
        import pandas as pd

        from mailsift.plans import registry

        for b in batches:
            yield pd.DataFrame({"n": [len(registry.queries())] * len(b)})

    from mailsift.plans import registry

    rows = spark.range(4, numPartitions=2).mapInPandas(count, "n long").collect()
    assert {r["n"] for r in rows} == {len(registry.queries())}


@pytest.mark.parametrize("module", ["mailsift.functions.patterns", "mailsift.plans.queries_profile"])
def test_no_files_read_at_import(module):
    """Importing opens nothing but Python's own modules and their packages."""
    code = f"""
import sys, pyspark.ml, pyspark.sql.functions, pyspark.sql.pandas.functions
opened = []
sys.addaudithook(lambda name, args: opened.append(str(args[0])) if name == "open" else None)
import {module}
bad = [f for f in opened if f.endswith((".jar", ".txt", ".json", ".csv"))]
assert not bad, bad
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, capture_output=True, text=True, timeout=300,
                         env=dict(os.environ, PYTHONPATH=REPO))
    assert out.returncode == 0, out.stderr
