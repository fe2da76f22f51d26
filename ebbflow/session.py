"""Session helpers shared by every part of the package."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers of any cluster, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="ebbflow-ship-"), "ebbflow.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for top, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.join("ebbflow", os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)


def build(app: str = "ebbflow", **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; ``conf`` overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.timestampType": "TIMESTAMP_NTZ",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    spark = SparkSession.builder.appName(app).config(map=settings).getOrCreate()
    ship(spark)
    return spark
