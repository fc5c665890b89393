"""Session settings. On a cluster the submitter's settings win; these are for local runs and tests."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: str | None = None) -> SparkSession:
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("finstrata")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cutting lineage: the cluster's setting. Where none is set, a new local one, on a local master only."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="finstrata-checkpoint-")
    sc.setCheckpointDir(shared)
    return sc.getCheckpointDir() or shared


def ship(spark: SparkSession) -> None:
    """Hand this package to the Python workers, once per application: they need not find it on their own path."""
    sc = spark.sparkContext
    if getattr(sc, "_finstrata_shipped", False):
        return
    root = Path(__file__).resolve().parent
    bundle = os.path.join(tempfile.mkdtemp(prefix="finstrata-package-"), "finstrata.zip")
    with zipfile.ZipFile(bundle, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, str(Path("finstrata") / path.relative_to(root)))
    sc.addPyFile(bundle)
    sc._finstrata_shipped = True
