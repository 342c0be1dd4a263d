import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])  # of the driver; its workers do not get it
from gleanbase.llm.queries import QUERIES
from gleanbase.session import build_session
spark = build_session("workers", "local[4]", **{
    "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "4",
    "spark.checkpoint.dir": sys.argv[2]})

def has_package(batches):
    import importlib.util
    for batch in batches:
        assert importlib.util.find_spec("gleanbase") is None
        yield batch

spark.range(4).mapInArrow(has_package, "id long").count()
for name, fn in QUERIES.items():
    print(name, fn(spark, "/root/testdata/sf0.001").count(), flush=True)
"""


def test_executors_need_no_copy_of_this_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    env["PYTHONPATH"] = os.pathsep.join(p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and os.path.abspath(p) != REPO)
    done = subprocess.run([sys.executable, "-c", SCRIPT, REPO, str(tmp_path / "shared")], cwd=tmp_path, env=env, timeout=1200,
                          capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-3000:]
    assert "op5_packing" in done.stdout and "op1_language" in done.stdout
