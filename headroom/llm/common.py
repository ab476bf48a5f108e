"""Small helpers shared by the text operators."""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from headroom.session import ensure_checkpoint_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the folder named by ``spark.checkpoint.dir`` and read
    it back: later uses scan the files, a lost executor recomputes nothing
    upstream, and values that depend on task numbers are fixed by the write.
    The shuffle files of the write go with its end, not when the driver collects its garbage."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/headroom-tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def forgotten(*tables: DataFrame) -> None:
    """Delete the files of stored tables that nothing reads any more: what was made of them is stored itself."""
    for table in tables:
        for name in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def whole_text(name: str = "text") -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def runs(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.RecordBatch]:
    """Runs of two rows or more with equal (integer) keys, from batches sorted by them; holds one run and one batch."""
    held = None
    for batch in itertools.chain(batches, [None]):
        if batch is not None and not len(batch):
            continue
        if batch is not None:
            held = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        if held is None:
            return
        change = np.zeros(len(held) - 1, bool)
        for key in keys:
            values = held.column(key).to_numpy()
            change |= values[1:] != values[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist()] + ([len(held)] if batch is None else [])
        for low, high in zip(cuts, cuts[1:]):
            if high - low > 1:
                yield held.slice(low, high - low)
        held = held.slice(cuts[-1])
