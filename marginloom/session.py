"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

# The jobs hold wide projections. Above 8000 bytes of bytecode the JVM never compiles a
# generated method and interprets it row by row; with this limit Spark splits it instead.
# Shuffled facts are narrow, and each order's sums are wide: 64 MB of them, Spark's default for a
# task, need ten times that in the hash map that combines them.
# Shuffle files are deleted as the execution that wrote them ends, not at some later collection of garbage:
# large loads run as many executions, and their shuffles would lie on disk side by side.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings the jobs rely on; all of them may change in a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("marginloom")
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Temporary roots of local sessions without a checkpoint folder, by application. Spark takes that setting only at start.
_OWN_ROOTS: dict[str, str] = {}


def _own_root(spark: SparkSession) -> str:
    application = spark.sparkContext.applicationId
    if application not in _OWN_ROOTS:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
        _OWN_ROOTS[application] = tempfile.mkdtemp(prefix="run-")
    return _OWN_ROOTS[application]


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, the place every executor can reach.

    Only a local master may fall back to a temporary folder of this machine, one for each application.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or _own_root(spark)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"
