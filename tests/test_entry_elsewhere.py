"""The driver may import __spark_entry__ from any working directory: Python
stages must still find the package on the workers."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location('__spark_entry__', {os.path.join(REPO, '__spark_entry__.py')!r})
E = importlib.util.module_from_spec(spec); spec.loader.exec_module(E)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')
         .config('spark.ui.showConsoleProgress', 'false').getOrCreate())
spark.sparkContext.setLogLevel('ERROR')
print('ROWS', E.queries()['parsed'](spark, '/root/testdata/sf0.001').count())
print('ENTRY', E.entry(spark).count())
"""


def test_udf_query_from_another_directory():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    with tempfile.TemporaryDirectory() as cwd:
        out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=cwd, env=env, capture_output=True,
                             text=True, timeout=600)
    assert "ROWS " in out.stdout, out.stderr[-2000:]
    assert int(out.stdout.split("ROWS ")[1].split()[0]) > 0
    assert int(out.stdout.split("ENTRY ")[1].split()[0]) > 0
