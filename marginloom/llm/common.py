"""Helpers the operators of this package share."""

from __future__ import annotations

import hashlib
import io
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginloom.session import shared_folder

# Documents run to megabytes; Arrow batches of so many rows keep a Python worker small.
BATCH_ROWS = 256


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, purpose: str, *partition_by: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: cuts lineage, survives lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def for_python(spark: SparkSession) -> None:
    """Bound Arrow batches and give the workers this package, wherever the driver was started."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = Path(__file__).resolve().parents[2]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as archive:
        for file in sorted((root / "marginloom").rglob("*.py")):
            archive.writestr(zipfile.ZipInfo(str(file.relative_to(root))), file.read_bytes())
    name = f"marginloom-{hashlib.sha1(held.getvalue()).hexdigest()[:12]}.zip"
    context = spark.sparkContext
    if name not in {Path(f).name for f in context.listFiles}:
        folder = Path(context._temp_dir)
        (folder / name).write_bytes(held.getvalue())
        context.addPyFile(str(folder / name))


def salted_left_join(rows: DataFrame, groups: DataFrame, key: str, spread: Column, salts: int = 32) -> DataFrame:
    """Left join rows to one record per ``key``; every key is cut into ``salts`` parts, whatever its size.

    ``spread`` is a value of the row that differs within a group. Null keys find nothing.
    """
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "_salt"], "left").drop("_salt")
