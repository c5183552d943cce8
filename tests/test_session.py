import os
import subprocess
import sys
from types import SimpleNamespace

import pytest

from querytally.session import shared_dir

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ELSEWHERE = """
import sys
sys.path.insert(0, {root!r})
from querytally.operators.compare import frames_equal
from querytally.operators.nearest import nearest_objects
from querytally.session import get_session
spark = get_session("elsewhere", "local[2]", spark__sql__shuffle__partitions=2, spark__ui__enabled="false")
o = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(9)], "object_id int, vector array<float>")
q = o.selectExpr("object_id as query_id", "vector")
for values in (1000, 4):
    assert nearest_objects(q, o, 1, 2, block_values=values).filter("query_id = object_id").count() == 9
a = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (1, 1, 2)], "a int, b int, c int")
assert frames_equal(a.select("b", "c", "a"), a)
from querytally.plans import QUERIES
for name in ("case_files", "ref_tables"):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("fine")
"""


def test_runs_from_any_folder(tmp_path):
    """Executors do not have the package on their path."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", ELSEWHERE.format(root=ROOT)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]


def test_scratch_leaves_other_frames(spark):
    """The shared folder holds no more after a block than before, and frames from outside live on."""
    from querytally.operators.numbering import number_rows
    from querytally.session import scratch, written

    outside = written(spark.range(5))
    folder = shared_dir(spark)

    def files():
        return sorted(os.path.join(d, f) for d, _, names in os.walk(folder) for f in names)

    before = files()
    with scratch(spark):
        numbered = number_rows(spark.range(100).selectExpr("id % 7 AS k", "id"), ["k", "id"])
        with scratch(spark):
            inner = written(numbered.filter("n <= 3"))
            assert inner.count() == 3
        assert numbered.count() == 100 and files() != before
    assert files() == before and outside.count() == 5


def fake(named, master, made):
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: made.get("dir"),
                              setCheckpointDir=lambda d: made.update(dir=d))
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named or default), sparkContext=context)


def test_shared_dir():
    assert shared_dir(fake("hdfs:///shared", "spark://host", {})) == "hdfs:///shared"
    made = {}
    first = shared_dir(fake(None, "local[2]", made))
    assert made["dir"] == first == shared_dir(fake(None, "local[2]", made))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(fake(None, "spark://host", {}))
