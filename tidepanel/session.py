"""A Spark session with the settings that the library counts on."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A ticker such as 0700 stays a string.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "tidepanel", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors of a session, once: for those that don't have it installed. The archive is made
    on the driver, from where Spark distributes it."""
    sc = spark.sparkContext
    if any(os.path.basename(f) == "tidepanel.zip" for f in sc.listFiles):
        return
    home = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="tidepanel-"), "tidepanel.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(home):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.join("tidepanel", os.path.relpath(full, home)))
    sc.addPyFile(path)
