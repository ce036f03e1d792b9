"""The driver's contract."""

import importlib
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SMALL = Path("/root/testdata/sf0.001")


def test_every_query_has_sql_or_a_reason():
    entry = importlib.import_module("__spark_entry__")
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 50
    without = {n for n in set(q) - set(sql) if n.startswith("q_")}
    assert without == {"q_composite_finalize", "q_controller_replay"}


@pytest.mark.skipif(not SMALL.exists(), reason="no test tables")
def test_flagship(spark):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0


def test_the_rest_imports_without_the_training_data_part(tmp_path):
    for name in ("pagemill", "__spark_entry__.py"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else subprocess.run(["cp", "-r", str(ROOT / name), str(tmp_path / name)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "pagemill" / "llm")], check=False)
    code = "import __spark_entry__ as e; assert not any(k.startswith('op') or k == 'pipeline' for k in e.queries()); e.oracle_sql()"
    link = tmp_path / "__spark_entry__.py"
    text = link.read_text()
    link.unlink()
    link.write_text(text)
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"})
