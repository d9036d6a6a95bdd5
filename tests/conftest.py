import os
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH")) if p)

import pytest  # noqa: E402

from notegrid.session import build_session, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", **{
        "spark.master": "local[4]", "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield tune(session)
    session.stop()


@pytest.fixture
def notes_of(spark):
    """Notes from ``{path: header}`` or ``{path: (header, body)}``."""
    import json

    from pyspark.sql import functions as F

    def make(rows: dict):
        data = []
        for path, value in rows.items():
            head, body = value if isinstance(value, tuple) else (value, "")
            folder, _, name = path.rpartition("/")
            data.append((path, name, folder, (head or {}).get("type"), None if head is None else json.dumps(head), body))
        df = spark.createDataFrame(data, "path string, name string, folder string, type string, j string, body string")
        return df.withColumn("fm", F.parse_json("j")).withColumn("directory_type", F.col("type")).drop("j")

    return make
