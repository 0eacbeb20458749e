"""Helpers that the corpus operators share: written intermediates and Arrow passes."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

BATCH_ROWS = 2000


class Placed:
    """A frame whose columns are known by their places (c0, c1, ...), so that no name clashes with an operator's own or needs quoting."""

    def __init__(self, df: DataFrame):
        self.names = df.columns
        self.df = df.toDF(*(f"c{i}" for i in range(len(self.names))))

    def place(self, name: str) -> str:
        """Where the column of this name is; one that differs in case only will do if there is no other."""
        same = [i for i, c in enumerate(self.names) if c == name] or [i for i, c in enumerate(self.names) if c.lower() == name.lower()]
        if not same:
            raise ValueError(f"no column {name!r} among {self.names}")
        return f"c{same[0]}"

    def __call__(self, name: str) -> Column:
        return F.col(self.place(name))

    def others(self, outputs: Iterable[str]) -> list[Column]:
        """The columns, under their names, that are not replaced by outputs."""
        taken = {x.lower() for x in outputs}
        return [F.col(f"c{i}").alias(c) for i, c in enumerate(self.names) if c.lower() not in taken]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, from `spark.checkpoint.dir`; a temporary one only where that is unset on local[*]."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = os.path.join(tempfile.gettempdir(), f"grainmill-{os.getpid()}")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{folder}")
    return f"file://{folder}"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read again: cuts the lineage, and survives the loss of any executor."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a frame from `written` that nothing reads any more."""
    spark = df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        delete_path(spark, f)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None


def give_back() -> None:
    """Returns a worker's freed memory to the system: pools and heap keep it otherwise, and an idle worker holds it beside the next stage."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def map_arrow(df: DataFrame, run: Callable, schema: str | T.StructType) -> DataFrame:
    """df.mapInArrow, with this package's folder on the Python path of the workers, wherever the driver was started.

    Whole texts are large rows: where the session has Spark's default of 10,000 rows a batch, it gets BATCH_ROWS.
    """
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = df.sparkSession.sparkContext.environment
    paths = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(whole, schema)


def with_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, pa.Array]], outputs: dict[str, T.DataType], keep: list[str] | None = None) -> DataFrame:
    """df with columns that fn computes batch by batch; a column of the same name is replaced. keep: the columns to pass on."""
    names, taken = df.columns, {x.lower() for x in outputs}
    keep = [i for i, c in enumerate(names) if c.lower() not in taken and (keep is None or c in keep)]
    schema = T.StructType([*(T.StructField(f"c{i}", df.schema[i].dataType) for i in keep), *(T.StructField(f"out{k}", t) for k, t in enumerate(outputs.values()))])
    inner = [f.name for f in schema]

    def run(batches):
        for b in batches:
            if b.num_rows:
                new = fn(pa.RecordBatch.from_arrays(b.columns, names=names))
                yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *(new[k] for k in outputs)], names=inner)
                give_back()

    return map_arrow(df.toDF(*(f"c{i}" for i in range(len(names)))), run, schema).toDF(*(names[i] for i in keep), *outputs)
