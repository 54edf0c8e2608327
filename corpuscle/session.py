"""Session helpers: building a local session, loading tables, shared scratch space."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cores: int = 8, app: str = "corpuscle", memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder that every executor can reach: ``spark.checkpoint.dir`` where the session names one.

    Where the setting is missing (tests, a laptop) a temporary folder is used, which is right only because driver and
    executors share a machine then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = os.path.join(tempfile.gettempdir(), "corpuscle-shared")
    return base.rstrip("/")


_OWN: dict[str, SparkSession] = {}


def app_dir(spark: SparkSession) -> str:
    """The folder below :func:`shared_base` for tables that are of use to this application only.

    It is deleted when the driver ends (or by :func:`clean`).
    """
    own = f"{shared_base(spark)}/corpuscle-{spark.sparkContext.applicationId}"
    if own not in _OWN:
        if not _OWN:
            atexit.register(clean)
        _OWN[own] = spark
    return own


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder in that of the application."""
    return f"{app_dir(spark)}/{label}-{uuid.uuid4().hex}"


def clean() -> None:
    """Delete the folders of this driver's applications. Frames that read from them can not be evaluated afterwards."""
    for own, spark in list(_OWN.items()):
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(own)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session is gone; a folder of this machine can still be deleted
            if "://" not in own:
                shutil.rmtree(own.removeprefix("file:"), ignore_errors=True)
        _OWN.pop(own, None)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(watch: Observation, name: str) -> int | None:
    """A metric that was observed on the way; None where the optimiser left the observed step out, as for an empty input."""
    try:
        return int(watch.get[name])
    except Exception:
        return None


def spread(df: DataFrame) -> DataFrame:
    """For costly maps right behind a scan: enough partitions to keep every core busy.

    A small table may be a single split. Where the scan already has as many splits as there are cores, which is so at
    any size that matters, nothing is shuffled. ``df`` must hold no exchange, as its plan is asked for its splits.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Rows of a table that is small by its meaning; an error, never a cut, if it is not."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows")
    return rows


def ext_of(rel) -> F.Column:
    """Lower-case extension of a path with its dot, '' where there is none."""
    return F.lower(F.regexp_extract(rel, r"(\.[^./\\]+)$", 1))


#: Language of a file by the extension of its path, as the corpus tables define it; all others are '*'.
TABLE_LANGS = {
    ".py": "python", ".js": "javascript", ".mjs": "javascript", ".ts": "typescript",
    ".go": "go", ".java": "java", ".rs": "rust", ".json": "json",
}


def table_lang(rel) -> F.Column:
    """Language of a path under :data:`TABLE_LANGS`."""
    out = F.lit("*")
    for ext, lang in TABLE_LANGS.items():
        out = F.when(F.lower(rel).endswith(ext), F.lit(lang)).otherwise(out)
    return out
