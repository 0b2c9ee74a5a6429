import subprocess
import sys

import pytest

from tesserae.sources.shared import shared_dir

ALONE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from tesserae.sources.shared import shared_dir
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
a, b = shared_dir(spark), shared_dir(spark.newSession())
assert a == b and a.startswith("file://")
spark.range(3).write.parquet(a + "/t")
assert spark.read.parquet(a + "/t").count() == 3
"""


def test_without_a_preset_folder(tmp_path):
    """With an empty Spark configuration a local application gets one folder of its own."""
    import os
    from pathlib import Path

    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path)}
    code = ALONE.format(repo=str(Path(__file__).resolve().parent.parent))
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]


def test_a_cluster_must_name_one():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(Session())
