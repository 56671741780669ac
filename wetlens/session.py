"""Session helpers: table loading and tables written to the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is what ``spark.checkpoint.dir`` names.  Only where that is unset (local
    tests) a temporary folder is made and set, and removed when Python ends.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="wetlens-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{own}")
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again.

    Cuts lineage: later stages re-read files when an executor is lost, and the
    optimizer knows the table's real size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and its class of paths."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def create(spark: SparkSession, path: str, text: str) -> None:
    """A small file, created in one step; fails if it is there already.

    The commit of a table: readers see the old list of folders or the new one.
    """
    fs, of = file_system(spark, path)
    out = fs.create(of(path), False)
    out.write(bytearray(text, "utf-8"))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, of = file_system(spark, path)
    size = fs.getFileStatus(of(path)).getLen()
    stream = fs.open(of(path))
    data = bytes(stream.readNBytes(size))
    stream.close()
    return data.decode("utf-8")


def dropped(*tables: DataFrame) -> None:
    """Removes tables that :func:`written` made and nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            fs, of = file_system(spark, path)
            fs.delete(of(path), True)
