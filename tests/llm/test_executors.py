"""Tasks of a cluster whose workers do not have this package."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
def there(batches):
    import importlib.util
    import pyarrow as pa
    for _ in batches:
        yield pa.RecordBatch.from_pydict({{"n": [int(importlib.util.find_spec("sparkwarden") is not None)]}})
assert [r.n for r in spark.range(1, numPartitions=1).mapInArrow(there, "n long").collect()] == [0]
from sparkwarden.llm.queries import QUERIES
for name in {names!r}:
    print(name, QUERIES[name](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("names", [("op1_multi_index", "op2_quality", "op13_vantage_clusters"), ("op11_resample", "op12_set_relations")])
def test_workers_without_the_package(tmp_path, names):
    script = SCRIPT.format(repo=str(REPO), names=list(names))
    bare = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=600, env=bare)
    assert done.returncode == 0, done.stderr[-3000:]
    assert [line.split()[0] for line in done.stdout.splitlines() if line.startswith("op")] == list(names)
