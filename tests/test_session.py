"""The package reaches the workers, wherever the driver was started."""

import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from assertloom.operators.verification import check_pairs
from assertloom.session import build_session
spark = build_session(master="local[1]", spark_sql_shuffle_partitions="1")
print(check_pairs(spark.createDataFrame([("a |-> ##9 b", "a |-> ##9 c")], "sva1 string, sva2 string")).first().result)
"""


def test_workers_find_the_package_from_another_folder(tmp_path):
    root = str(Path(__file__).resolve().parent.parent)
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False)
    assert run.returncode == 0 and run.stdout.split()[-1] == "not_implies", run.stderr[-2000:]
