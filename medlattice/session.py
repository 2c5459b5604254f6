"""Session settings, shared-folder tables and table loading used all over the package."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Largest number of rows that any helper collects or broadcasts as a control table.
CONTROL_ROWS = 10_000
#: Bytes beyond which no input is dealt out anew, however many cores there are.
SMALL_BYTES = 256 << 20


def build_session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects; on a cluster, master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName("medlattice")
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return ship(builder.config(map=settings | conf).getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python this package, once per application, as spark-submit --py-files would."""
    context = spark.sparkContext
    if not getattr(context, "_medlattice_shipped", False):
        root = Path(__file__).resolve().parent
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*")):
                if p.suffix in (".py", ".json") and "__pycache__" not in p.parts:
                    z.write(p, p.relative_to(root.parent))
        folder = tempfile.TemporaryDirectory(prefix="medlattice-py-")  # the driver serves it to the executors; deleted when Python ends
        place = Path(folder.name) / "medlattice.zip"
        place.write_bytes(packed.getvalue())
        _PACKED.append(folder)
        context.addPyFile(str(place))
        context._medlattice_shipped = True
    return spark


_PACKED: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session.

    Only where it is unset and the master is local is a temporary folder made; a cluster without the setting is an
    error, since a machine-local folder would be lost with its executor.
    """
    conf = spark.sparkContext.getConf()
    place = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if place:
        return place
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _LOCAL_DIR
    if _LOCAL_DIR is None:
        _LOCAL_DIR = tempfile.TemporaryDirectory(prefix="medlattice-")
    return f"file://{_LOCAL_DIR.name}"


_LOCAL_DIR: tempfile.TemporaryDirectory | None = None


def _own_folder(spark: SparkSession):
    """(path, file system) of this application's tables in the shared folder."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/medlattice/{spark.sparkContext.applicationId}")
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: its lineage is cut, and a lost executor costs nothing.

    The tables of an application lie in a folder of its own, which is deleted when its driver ends.
    """
    spark = df.sparkSession
    folder, files = _own_folder(spark)
    if not files.exists(folder):
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    path = f"{folder.toString()}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_materialised(spark: SparkSession) -> None:
    """Delete what materialise() wrote in this application; call it when no result that reads those tables is needed any more."""
    folder, files = _own_folder(spark)
    files.delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below sf_dir."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if its files are too small for a scan to give each core a split, else df as it is.

    A scan makes splits of spark.sql.files.openCostInBytes at least, so fewer bytes than that times the cores (and than
    SMALL_BYTES) leave cores idle. Only the plan's file sizes are looked at: no job runs, and no large input is shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    least = spark._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    return df.repartition(cores) if size < min(cores * least, SMALL_BYTES) else df


def collect_control(df: DataFrame, most: int = CONTROL_ROWS) -> list:
    """Rows of a control table (targets, limits); more than `most` rows are an error, never a silent cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a control table has more than {most} rows")
    return rows
