"""Session helpers shared by every operator: settings, lineage cuts and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes up to which a narrow lookup side may be broadcast; beyond either the join is salted.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32_000_000
#: Copies of the lookup side in a salted join, and so the number of tasks a hot key is spread over.
SALTS = 16


def local_session(cores: int | str = "*", app: str = "quire", **conf: str) -> SparkSession:
    """A local session with the settings the operators are written for."""
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
    } | conf
    return SparkSession.builder.master(f"local[{cores}]").appName(app).config(map=settings).getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the shared folder the cluster names; a folder of our own only for a session of one machine.

    On a cluster a folder of one machine would lose its tables with it, so there a session that names
    none is refused.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master.startswith("local") and not context.master.startswith("local-cluster")):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="quire-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint (survives the loss of executors)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Cut lineage with a table written to the shared checkpoint folder: compressed, and read by column."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, where a scan gives fewer (few or unsplit files).

    For steps that cost much CPU a row. A scan of a large table has more splits than cores and is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has no more than ``rows`` rows; reads at most one row beyond the bound."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    key: str,
    how: str = "left",
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
) -> DataFrame:
    """Join ``facts`` to a narrow ``lookup`` with unique ``key``.

    The lookup is evaluated once, into the shared folder, and measured there: it is broadcast when it
    has at most ``max_rows`` rows and BROADCAST_BYTES bytes. Beyond that each fact row gets
    one of ``salts`` salts and the lookup is repeated once a salt, so that a key which holds a third
    of all facts is spread over ``salts`` tasks. A null key finds nothing (kept by a left join).
    """
    lookup = stored(lookup)
    wide = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in lookup.dtypes if kind == "string"]
    row = sum(wide, F.lit(8 * (len(lookup.columns) + 1)))
    rows, size = lookup.agg(F.count("*"), F.coalesce(F.sum(row), F.lit(0))).first()
    if rows <= max_rows and size <= BROADCAST_BYTES:
        return facts.join(F.broadcast(lookup), key, how)
    salt = "_salt"
    left = facts.withColumn(salt, F.pmod(F.xxhash64(*[facts[c] for c in facts.columns[:4]]), F.lit(salts)).cast("int"))
    right = lookup.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [key, salt], how).drop(salt)


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row a key: the one greatest by ``order`` (nulls lowest), the rest of its columns breaking ties.

    A ranked window whose limit also works before the shuffle, so of a key delivered very often each
    task hands on one row. Null keys are no records and are dropped.
    """
    rest = [F.col(c) for c, kind in df.dtypes if c != key and not kind.startswith("map")]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*(c.desc_nulls_last() for c in (*order, *rest))))
    return df.where(F.col(key).isNotNull()).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
