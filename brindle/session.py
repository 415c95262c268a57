"""Session and storage helpers shared by every operator."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "brindle", cores: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own. Its workers find this package wherever they start."""
    home, have = str(Path(__file__).resolve().parents[1]), os.environ.get("PYTHONPATH", "")
    if home not in have.split(os.pathsep):
        os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (home, have) if x)
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


#: Tables whose rows cost far more to work through than to move.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Catalyst prunes its columns. Texts go to all cores."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def spread(rows: DataFrame) -> DataFrame:
    """rows as they are, or dealt out to all cores where their files give fewer tasks than there are cores.

    A small table is often one file of one row group, which one task would
    read and work through alone. A table of many files is never moved.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def ship(spark: SparkSession) -> None:
    """Send this package to a cluster's workers, where it is not installed there."""
    here = Path(__file__).resolve().parent
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), here.name), "zip", here.parent, here.name))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it.

    Only a local session that names none gets a temporary folder, remembered in
    the session; on a cluster each machine would write to its own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    have = spark.conf.get("brindle.scratch.dir", None)
    if not have:
        have = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("brindle.scratch.dir", have)
    return have


_WRITTEN: list[str] = []


def written(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df once to the shared folder and read it back.

    This cuts lineage so that a lost executor never forces the work above to
    be repeated, and it runs the plan once (checkpoint() runs it twice). The
    table stays until its `scratch` ends, or with the folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/brindle/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def written_files(path: str, write: Callable[[str], None]) -> str:
    """path, once write(path) has filled it; it goes when its `scratch` ends, as tables do."""
    write(path)
    _WRITTEN.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that `written` makes inside are removed at the end; what is computed from them must be written elsewhere by then."""
    begun = len(_WRITTEN)
    try:
        yield
    finally:
        for path in _WRITTEN[begun:]:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        del _WRITTEN[begun:]


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than are needed to tell."""
    return df.limit(most_rows + 1).count() <= most_rows
