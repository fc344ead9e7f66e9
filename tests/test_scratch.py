import os
import subprocess
import sys
import time

PROGRAM = """
import sys
from pyspark.sql import SparkSession
from sparkstill.operators import order
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
print("ROWS", order.row_numbers(spark.range(100).selectExpr("id", "id % 3 v"), "v", ["id"]).agg({"rn": "max"}).first()[0])
import os
print("FOLDERS", len([x for x in os.listdir(sys.argv[1]) if x.startswith("session-")]))
"""


def test_scratch_tables_go_with_the_driver(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    said = subprocess.run([sys.executable, "-c", PROGRAM, str(tmp_path)], cwd=root, capture_output=True, text=True, timeout=120)
    assert "ROWS 100" in said.stdout and "FOLDERS 1" in said.stdout, said.stderr[-2000:]
    end = time.time() + 30  # the driver's JVM ends a little after its Python process
    while list(tmp_path.glob("session-*")) and time.time() < end:
        time.sleep(0.2)
    assert not list(tmp_path.glob("session-*"))
