"""The Spark session and reading of tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def session(app: str = "docloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that results depend on (UTC) and adaptive execution; master and sizes are the deployment's."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else what the context has. In local mode, where all is one machine (tests), a new one if there is none; a cluster without one is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="docloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder. What is written there goes when the session ends."""
    path = f"{shared_dir(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """df as a table in the shared folder: computed once, its lineage cut, and a lost executor loses none of it."""
    path = shared_path(df.sparkSession, name)
    (df.write if compression is None else df.write.option("compression", compression)).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether df has few enough rows to be broadcast; looks at no more than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """df, to be broadcast if it has at most `rows` rows. It is computed for the count, so it should be cheap or stored."""
    return F.broadcast(df) if small(df, rows) else df


#: Rows that a function of map_batches() gets at once.
ROWS = 500


def map_batches(df: DataFrame, run: Callable, schema: str, ids: tuple[str, ...] = ("doc_id",), rows: int = ROWS) -> DataFrame:
    """df.mapInPandas(run, schema), but that run gets a batch in parts of `rows`, so that what it makes of large texts is not as large as a whole batch's, and whole numbers in the columns named in ids go there and back as text: where a column has nulls, pandas would make floats of them, and of large ids other ids."""
    kinds = T._parse_datatype_string(schema)
    whole = {f.name for f in df.schema if f.name in ids and isinstance(f.dataType, T.IntegralType)}
    given = df.select(*[F.col(c).cast("string").alias(c) if c in whole else F.col(c) for c in df.columns])
    told = T.StructType([T.StructField(f.name, T.StringType() if f.name in whole else f.dataType) for f in kinds])

    def parts(batches: Iterator) -> Iterator:
        return run(b.iloc[at : at + rows].reset_index(drop=True) for b in batches for at in range(0, len(b), rows))

    return given.mapInPandas(parts, told).select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in whole else F.col(f.name) for f in kinds])
