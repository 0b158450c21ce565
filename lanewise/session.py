"""What a session needs: this package on its executors, and a shared folder to cut lineage in."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Add the package's sources to the running application once."""
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        root = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="lanewise-")) / "lanewise.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        sc.addPyFile(str(archive))
        _sent.add(sc.applicationId)
    return spark


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which driver and executors share; only where it is unset, and
    the session runs on one machine, a temporary one."""
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    folder = found.get() if found.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="lanewise-"))
    return _own[0]


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return it without its lineage."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
