"""Making the package known to a session: the landing source, the code on executors, a work folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path
from weakref import WeakSet

from pyarrow.fs import FileSelector
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from sealroute.sources.landing import LandingSource
from sealroute.sources.storage import exists, locate

_shipped: set[str] = set()
_attached: WeakSet[SparkSession] = WeakSet()


def attach(spark: SparkSession) -> SparkSession:
    """Ship the package to the executors and register the ``landing`` source, once per session."""
    if spark in _attached:
        return spark
    application = spark.sparkContext.applicationId
    if application not in _shipped:
        package = Path(__file__).resolve().parent
        bundle = Path(SparkFiles.getRootDirectory()) / "bundle" / package.name
        bundle.parent.mkdir(exist_ok=True)
        spark.sparkContext.addPyFile(shutil.make_archive(str(bundle), "zip", package.parent, package.name))
        _shipped.add(application)
    spark.dataSource.register(LandingSource)
    # The source tests filters itself, which Spark only asks of it with this setting.
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    _attached.add(spark)
    return spark


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for this run's tables in the shared folder the cluster names.

    Only a local session without that setting gets a temporary folder of its own.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="sealroute-work-")
    return f"{shared.rstrip('/')}/sealroute/{name}-{uuid.uuid4().hex}"


def keep(table: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table once and continue from the written rows, so nothing upstream runs again."""
    table.write.mode("overwrite").parquet(f"{folder}/{name}")
    return table.sparkSession.read.schema(table.schema).parquet(f"{folder}/{name}")


def done(folder: str, name: str) -> bool:
    """Whether a table of this name was written to the end."""
    return exists(*locate(None, f"{folder}/{name}/_SUCCESS"))


def keep_once(table: DataFrame, folder: str, name: str) -> DataFrame:
    """Like ``keep``, but a table that an earlier run wrote to the end is read and not made again."""
    if not done(folder, name):
        return keep(table, folder, name)
    return table.sparkSession.read.schema(table.schema).parquet(f"{folder}/{name}")


def journal_run(journal: str, last_table: str) -> str:
    """The folder of the run that a journal is at: the last one if it was broken off, else a new one.

    A run is over when its ``last_table`` was written to the end.
    """
    base = journal.rstrip("/")
    filesystem, inner = locate(None, base)
    found = filesystem.get_file_info(FileSelector(inner, allow_not_found=True))
    numbers = [int(info.base_name.removeprefix("run-")) for info in found if info.base_name.startswith("run-")]
    last = max(numbers, default=0)
    over = not numbers or done(f"{base}/run-{last:06d}", last_table)
    return f"{base}/run-{last + over:06d}"
