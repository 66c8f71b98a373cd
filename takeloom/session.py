"""Tables, stage files and value rules shared by all operators."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir. Where none is set, a folder of our own in local mode; elsewhere executors couldn't read it, so it raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="takeloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def stage_folder(spark: SparkSession, name: str = "stage") -> str:
    """A new folder in the shared folder, removed with all it holds when the application ends."""
    path = f"{stage_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives lost executors, and is removed when the application ends."""
    path = stage_folder(df.sparkSession, name) + "/rows"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def key(c: str | Column) -> Column:
    """A key as it is compared: without outer spaces, in lower case."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def value_or_null(c: str | Column) -> Column:
    """Trimmed text, with NULL for what counts as no value: NULL, blank and the text nan in any case."""
    t = F.trim((F.col(c) if isinstance(c, str) else c).cast("string"))
    return F.when((t != "") & (F.lower(t) != "nan"), t)


#: What counts as a number in text. Spark's own cast would also take "1d" or "Infinity".
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def canonical(c: str | Column) -> Column:
    """One spelling for equal values: numbers as DOUBLE, true and false without case, other text trimmed, NULL for no value."""
    t = value_or_null(c)
    number = F.when(t.rlike(NUMBER), F.expr("0D") + t.try_cast("double"))  # 0 + -0.0 = 0.0
    low = F.lower(t)
    return F.coalesce(number.cast("string"), F.when(low.isin("true", "false"), low), t)


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of all executors, wherever they run; once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="takeloom-")) / "takeloom.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)


_SHIPPED: set[str] = set()
