"""The package's way to the executors, and the folder they share with the driver."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
#: Folders that this process has named in the shared one.
folders: list[str] = []


def ship(spark: SparkSession) -> None:
    """Give executors this package, once an application, through Spark's own file server."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="rowlens-"), f"{root.name}.zip")
    atexit.register(shutil.rmtree, target.parent, ignore_errors=True)
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (local tests) is one made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="rowlens-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A name for a new folder in the shared one."""
    folders.append(f"{shared_dir(spark)}/rowlens/{name}-{uuid.uuid4().hex}")
    return folders[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what is read twice is the same twice."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
