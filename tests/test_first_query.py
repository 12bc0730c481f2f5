"""What only fails in the first queries of a session, whose columns have the lowest numbers."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import functions as F
from loomframe import operators as op
from loomframe.session import local_session
import pyarrow as pa, pyarrow.parquet as pq
# As many columns as make the price the column that a search in cut points is mistaken for.
wide = {{c: range(600) for c in "abc"}}
pq.write_table(pa.table({{"i": range(600), **wide, "v": [i * 700.0 % 60000 for i in range(600)], "d": range(600)}}), "left.parquet")
pq.write_table(pa.table({{"id": range(600), **wide, "d": range(600), "p": [float(i // 2 * 2) for i in range(600)]}}), "right.parquet")
spark = local_session(2)
spark.conf.set("loomframe.rowsPerBlock", "100")
left = spark.read.parquet("left.parquet").select("i", "v", (F.col("v") / 100).alias("scaled"))
prices = spark.read.parquet("right.parquet").groupBy(F.col("p").alias("price")).agg(F.count(F.lit(1)).alias("n"))
got = op.join_closest(left, prices, "scaled", ">=", "price", strategy="scan")
print("rows", got.where("price = floor(scaled / 2) * 2 and n = 2").count())
"""


def test_scan_joins_as_the_first_query_of_a_session(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=REPO)],
        cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300,
    )
    assert "rows 600" in out.stdout, out.stderr[-2000:]
