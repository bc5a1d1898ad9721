"""The session helpers outside the repository's folder and without any configuration."""

from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry", {os.path.join(ROOT, "__spark_entry__.py")!r})
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from machlog.session import get_spark
spark = get_spark("local[2]", shuffle_partitions=2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
assert spark.sparkContext.getCheckpointDir()
assert entry.entry(spark).count() > 0
from machlog.functions.timefn import parse_period  # a Python worker must find the package as well
found = spark.sparkContext.parallelize([1], 1).map(lambda _: __import__("machlog.functions.timefn").__name__).collect()
assert found == ["machlog"], found
print("fine")
"""


def test_empty_configuration_from_another_folder(tmp_path):
    conf = tmp_path / "conf"
    conf.mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_CONF_DIR": str(conf)}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "fine" in done.stdout, done.stderr[-3000:]
