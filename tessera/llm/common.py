"""Shared-folder helpers of the training-data operators.

Every intermediate table is written below ``spark.checkpoint.dir`` (a folder that the driver and all
executors share), so that a lost executor costs only the tasks that it ran. Where the setting is absent a local master gets a folder
of this machine, any other an error. A session's tables lie in one folder: ``release`` drops a table that nothing reads any
more, ``sweep`` the whole folder, at the latest when Python ends.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Work space of the texts' word rule: space and the code points 9 to 13.
WHITESPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; one of this machine's own only on a local master where none is named."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    own = os.path.join(tempfile.gettempdir(), f"tessera-{os.getuid()}")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


_sessions: dict[str, tuple[SparkSession, str]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    key = spark.sparkContext.applicationId
    if key not in _sessions:
        if not _sessions:
            atexit.register(sweep)
        _sessions[key] = spark, f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    return f"{_sessions[key][1]}/{name}-{uuid.uuid4().hex}"


def sweep() -> None:
    """Drop everything that this process wrote below the shared folder. Results that were not yet computed are lost with it."""
    while _sessions:
        spark, path = _sessions.popitem()[1]
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone by then, with whatever cleans up after it
            pass


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote below the shared one."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and is computed once."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    return out


def release(df: DataFrame | None) -> None:
    """Drop the files of a table that ``materialize`` wrote, once nothing reads it any more."""
    path = getattr(df, "_tessera_path", None)
    if path:
        remove(df.sparkSession, path)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    """Number of maximal runs that hold no space and none of the code points 9 to 13."""
    core = F.btrim(text, F.lit(BLANKS))
    return F.when(core == "", F.lit(0)).otherwise(F.size(F.split(core, WHITESPACE))).cast("long")


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small literal table, built by the JVM alone (numbers and plain strings)."""
    if len(rows) > 2000:
        return spark.createDataFrame(rows, schema)
    names = [part.split()[0] for part in schema.split(",")]
    types = [part.split()[1] for part in schema.split(",")]

    def cell(v) -> str:
        if v is None:
            return "NULL"
        if isinstance(v, float):
            return f"{v!r}D"
        return str(v) if isinstance(v, int) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"

    body = ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows or [(None,) * len(names)])
    picked = ", ".join(f"CAST(c{i} AS {t}) AS {n}" for i, (n, t) in enumerate(zip(names, types)))
    table = spark.sql(f"SELECT {picked} FROM VALUES {body} AS t({', '.join(f'c{i}' for i in range(len(names)))})")
    return table if rows else table.limit(0)
