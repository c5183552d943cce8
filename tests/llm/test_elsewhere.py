import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
ELSEWHERE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from querytally.llm import QUERIES
from querytally.session import get_session
spark = get_session("elsewhere", "local[4]", spark__sql__shuffle__partitions=4, spark__ui__enabled="false")
for name in [*QUERIES, "pipeline"]:
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("fine")
"""


def test_operators_run_from_any_folder(tmp_path):
    """Executors do not have the package on their path."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", ELSEWHERE.format(root=ROOT)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=600)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
