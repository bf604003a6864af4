"""The session, and the shared folder in which tables that cut lineage are written."""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "assertloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for; `conf` overrides any of them (underscores for dots).

    The package itself is sent to the workers, wherever the driver was started; on a cluster without `spark.checkpoint.dir` it must be
    there already (`--py-files`, or installed).
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = builder.config(map=settings).getOrCreate()
    _ship(spark)
    return spark


def _ship(spark: SparkSession) -> None:
    """Sends this package to the workers as a zip in the shared folder, once a session."""
    try:
        folder = shared_dir(spark)
    except ValueError:
        return
    root, data = Path(__file__).parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f"{root.name}/{f.relative_to(root)}"), f.read_bytes())
    path = f"{folder.rstrip('/')}/{root.name}-{hashlib.sha256(data.getvalue()).hexdigest()[:16]}.zip"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        out = fs.create(target)
        out.write(data.getvalue())
        out.close()
    spark.sparkContext.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: `spark.checkpoint.dir`, or, only where that is unset on a local master, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    folder = folder or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="assertloom-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir("file://" + own)
    return "file://" + own


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt out evenly over four tasks a core, before steps that cost far more than moving its rows."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}


def arrow_batch(columns: Iterable[Sequence], schema: str) -> pa.RecordBatch:
    """Columns as an Arrow batch; `schema` is `name type, name type, ...`."""
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


_tables: dict[str, SparkSession] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under the shared one, deleted by release() or when Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    if not _tables:
        atexit.register(_release_all)
    _tables[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back: its lineage ends there, and it survives the loss of executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes the written tables that `df` reads, once nothing reads them any more."""
    for path in [p for p in _tables if any(f.startswith(p) or p.removeprefix("file://") in f for f in df.inputFiles())]:
        _delete(path)


def _delete(path: str) -> None:
    spark = _tables.pop(path, None)
    if spark is None:
        return
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: only a local folder can still be deleted
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


def _release_all() -> None:
    for path in list(_tables):
        local = path.removeprefix("file://")
        if os.path.isdir(local):
            _tables.pop(path, None)
            shutil.rmtree(local, ignore_errors=True)
        else:
            _delete(path)
