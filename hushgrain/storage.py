"""Places for intermediate tables, and joins that check sizes before they broadcast.

Iterative operators cut their lineage by writing a table into the folder that all
executors share (``spark.checkpoint.dir``).  The files are ordinary Parquet, so a lost
executor costs nothing but a re-read.  The files of an application are deleted when its driver ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes (as text) up to which a side may be broadcast.  The driver gathers, hashes and sends what is broadcast, and a
#: row is up to four times its text there, so a side takes it at most about 2 MB, however large the tables are.
BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 512 << 10

_own_dir: str | None = None
_used: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; in local mode without one, a folder of our own.

    On a cluster without ``spark.checkpoint.dir`` this raises: a machine-local folder
    would be invisible to the other executors.
    """
    global _own_dir
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        set_by_hand = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = set_by_hand.get() if set_by_hand.isDefined() else None
    if where:
        return where.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="hushgrain-")
        import shutil

        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return _own_dir


def application_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes with the driver, however that ends in order."""
    path = f"{shared_dir(spark)}/hushgrain/{spark.sparkContext.applicationId}"
    if path not in _used:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _used.add(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it from there.  Cuts lineage."""
    spark = df.sparkSession
    path = f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._hushgrain_path = path
    return out


def release(*frames: DataFrame) -> None:
    """Delete materialised tables that no later result reads."""
    for df in frames:
        path = getattr(df, "_hushgrain_path", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether ``df`` has at most ``rows`` rows of ``size`` bytes together; reads no more than that many rows plus one."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n <= rows and held <= size


def lookup_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS, salts: int = 16, where: Column | None = None) -> DataFrame:
    """Join a large side with a lookup side whose keys may be hot in the large one.

    The lookup side is broadcast if it is measured to be small (:func:`is_small`).  Beyond
    that both sides are salted, so no key of the large side ends up in one task.  The planner would still broadcast
    copies whose files are below its threshold, since it takes an exploded side for as small as the files; the hint forbids it.
    ``where`` is a further condition of the match, over columns that only one side has.
    Null keys match nothing, as in SQL.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"{how} joins can't be salted")
    if is_small(right, rows):
        return _joined(left, F.broadcast(right), on, how, where)
    salt = "_hg_salt"
    spread = right.withColumn(salt, F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    salted = left.withColumn(salt, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns if not left.schema[c].dataType.typeName() == "map"]), F.lit(salts)).cast("int"))
    return _joined(salted, spread.hint("merge"), [*on, salt], how, where).drop(salt)


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str, where: Column | None) -> DataFrame:
    if where is None:
        return left.join(right, on, how)
    r = right.withColumnsRenamed({c: f"_hg_{c}" for c in on})
    same = where
    for c in on:
        same = (F.col(f"`{c}`") == F.col(f"`_hg_{c}`")) & same
    return left.join(r, same, how).drop(*[f"_hg_{c}" for c in on])
