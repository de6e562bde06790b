"""Session helpers shared by every operator: reading tables, cutting lineage, sizing broadcasts."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in bytes as Spark's own statistics see it, that an operator hints as a broadcast.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where that is unset, a local session (tests) gets a temporary one; on a cluster, whose hosts share no such folder, it is an error."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not conf and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all hosts share")
        sc.setCheckpointDir(conf or tempfile.mkdtemp(prefix="wayflow-checkpoint-"))
    return conf or sc._jsc.sc().getCheckpointDir().get()


#: Largest size in bytes that a cut table takes over from the plan behind it: a long number's.
MOST_SIZE = 2**63 - 1


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so that a lost executor costs no recomputation of what came before.

    A checkpoint inherits the planner's size of its plan, and a join's is the product of its sides'. From cut to cut the number of its digits would
    multiply, until a loop's driver does nothing but multiply; a size beyond any real one is therefore forgotten with the lineage.
    """
    checkpoint_dir(df.sparkSession)
    done = df.checkpoint(eager=True)
    plan, jvm = done._jdf.queryExecution().logical(), df.sparkSession._jvm
    if plan.stats().sizeInBytes() <= MOST_SIZE:
        return done
    none = jvm.scala.Option.empty()
    plain = jvm.org.apache.spark.sql.execution.LogicalRDD(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), False, none, df.sparkSession._jsparkSession, none, none)
    return DataFrame(jvm.org.apache.spark.sql.classic.Dataset.ofRows(df.sparkSession._jsparkSession, plain), df.sparkSession)


def release(spark: SparkSession) -> None:
    """Let go of what is no longer referred to: shuffles, checkpoints and broadcasts stay until the driver collects its garbage, which by itself it does when its heap is full."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def measured(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a checkpointed table as a broadcast only if its rows, written as JSON, have at most ``limit`` bytes together."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] if df.columns else 0
    return F.broadcast(df) if (size or 0) <= limit else df


def fresh(df: DataFrame) -> DataFrame:
    """The same columns under new identities, for joining a table with what was derived from it."""
    return df.toDF(*df.columns)
