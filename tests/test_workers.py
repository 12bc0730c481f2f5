import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from loomframe import operators as op
from loomframe.session import local_session
spark = local_session(2)
df = spark.createDataFrame([(i, 1.0) for i in range(4000)], "o int, x double")
a = op.accumulate_affine(df, 1.0, "x", order_by="o", limit=1000).where("acc = o + 1").count()
b = op.accumulate(df, lambda k, x: k + x, "x", [], "o").where("acc = o + 1").count()
print("rows", a, b)
"""


def test_python_steps_need_no_install_on_the_workers(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=REPO)],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300,
    )
    assert "rows 4000 4000" in out.stdout, out.stderr[-2000:]
