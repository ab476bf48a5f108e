"""Sources and sinks.

Tables are Parquet.  A rebuild swaps whole versions (``sources.store``), a snapshot replaces its partition, an extract is one file
renamed into place: a re-run (or a retried job after an executor loss) replaces its own output."""

from __future__ import annotations

import csv
import io as text_io
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headroom.functions.clean import raw_json
from headroom.operators.accountability import snapshot_rows
from headroom.sources.store import Files, TableStore

col = F.col

#: Bytes of a file that its header record must fit in.
HEADER_BYTES = 1 << 16
CSV = {"quote": '"', "escape": '"', "header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}


def _export_files(files: Files, path: str) -> list[str]:
    p = files.path(path)
    if files.fs.isFile(p):
        return [path]
    found = [f for f in files.fs.listStatus(p) if f.isFile()]
    return sorted(f.getPath().toString() for f in found if not f.getPath().getName().startswith(("_", ".")))


def _header(files: Files, name: str) -> list[str]:
    """The column names of a file's first record, which may span lines; [] of an empty file."""
    start = files.read(name, HEADER_BYTES).decode("utf-8-sig", "replace")
    return [c.strip() for c in next(csv.reader(text_io.StringIO(start, newline="")), [])]


def read_export(spark: SparkSession, path: str, columns: list[str], multi_line: bool = True) -> DataFrame:
    """A1: CSV exports with a header, quoted commas and line breaks, every cell a string.

    Columns are taken by the names in each file's own header, in whatever order and among whatever others (names compare
    trimmed, without case); a file without one of ``columns``, or with one of them twice, is an error.  A record with too few or too many cells, or
    that does not parse, keeps what could be read and carries its text in ``corrupt`` (null otherwise; see ``split_corrupt``).
    ``seq`` orders the rows as ingested: by file, place of the block in its file, row.

    Files of equal header are read together, so there is one scan per header, not per file.  Records over line breaks
    keep a file in one task; ``multi_line=False`` splits large files whose records never hold line breaks."""
    files = Files(spark, path)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for name in _export_files(files, path):
        header = tuple(c.lower() for c in _header(files, name))
        if header:
            by_header.setdefault(header, []).append(name)
    out = None
    for header, names in by_header.items():
        for c in columns:
            if header.count(c.lower()) != 1:
                raise ValueError(f"{names[0]}: column {c!r} occurs {header.count(c.lower())} times in its header {list(header)}")
        schema = ", ".join(f"`c{k}` string" for k in range(len(header))) + ", `__corrupt` string"
        df = spark.read.schema(schema).options(**CSV, multiLine=multi_line).csv(names)
        df = df.select(*[col(f"c{header.index(c.lower())}").alias(c) for c in columns], col("__corrupt").alias("corrupt"),
                       F.struct(col("_metadata.file_path"), col("_metadata.file_block_start"),
                                F.monotonically_increasing_id().alias("row")).alias("seq"))
        out = df if out is None else out.unionByName(df)
    if out is None:
        out = spark.createDataFrame([], ", ".join(f"`{c}` string" for c in [*columns, "corrupt"])
                                    + ", seq struct<file_path: string, file_block_start: bigint, row: bigint>")
    return out


def split_corrupt(rows: DataFrame, source_file: str) -> tuple[DataFrame, DataFrame]:
    """The sound rows of ``read_export``, and the others as exceptions (``seq, source_file, raw_row, reason``)."""
    good = rows.where(col("corrupt").isNull()).drop("corrupt")
    bad = rows.where(col("corrupt").isNotNull()).select(
        "seq", F.lit(source_file).alias("source_file"), raw_json([c for c in rows.columns if c != "seq"]).alias("raw_row"),
        F.lit("record does not fit its header").alias("reason"))
    return good, bad


def rebuild(tables: dict[str, DataFrame], out_dir: str) -> dict[str, str]:
    """A2: full refresh of a table store: readers see the old version of all tables or the new one of all."""
    spark = next(iter(tables.values())).sparkSession
    return TableStore(spark, out_dir).rebuild(tables)


def append_snapshot(space_collision: DataFrame, run_date: str, path: str) -> DataFrame:
    """A3: replace this run date's predictions (partition overwrite) with the
    current (site, space, breach, util) rows whose utilisation is known.
    Idempotent per date.  Returns the rows written."""
    rows = snapshot_rows(space_collision.withColumn("snapshot_date", F.lit(run_date).cast("date")))
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("snapshot_date").parquet(path))
    return rows


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("snapshot_date", col("snapshot_date").cast("date"))


def publish(views: dict[str, DataFrame], out_dir: str) -> dict[str, str]:
    """A4: one CSV file per published view (``<view>/part-<view>.csv``, with its real header even when empty), rows in the view's order;
    returns the folders.

    The tasks of the view's last stage write one headless part each (a sorted view is range-partitioned, so the parts in a row
    are the sorted rows); the commit joins the parts behind the header, by the file system itself where it can concatenate, else as a
    stream of bytes with a fixed buffer, and renames the result into place."""
    return {name: _publish_one(df, f"{out_dir.rstrip('/')}/{name}") for name, df in views.items()}


def _csv_line(names: list[str]) -> bytes:
    line = text_io.StringIO()
    csv.writer(line, lineterminator="\n").writerow(names)
    return line.getvalue().encode()


def _publish_one(df: DataFrame, base: str) -> str:
    files, staging = Files(df.sparkSession, base), f"{base}.{uuid.uuid4().hex}.parts"
    df.write.option("header", False).option("escape", '"').csv(staging)
    parts = [f"{staging}/{n}" for n in files.names(staging) if n.startswith("part-")]
    whole = f"{staging}/whole"
    files.write(whole, _csv_line(df.columns))
    try:
        if parts:
            array = df.sparkSession.sparkContext._gateway.new_array(files.jvm.org.apache.hadoop.fs.Path, len(parts))
            for k, part in enumerate(parts):
                array[k] = files.path(part)
            files.fs.concat(files.path(whole), array)
    except Exception as e:
        if "UnsupportedOperation" not in f"{type(e).__name__} {e}":
            raise
        out = files.fs.create(files.path(f"{whole}.joined"), True)
        for part in [whole, *parts]:
            stream = files.fs.open(files.path(part))
            files.jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 16, False)
            stream.close()
        out.close()
        whole = f"{whole}.joined"
    target = f"{base}/part-{base.rsplit('/', 1)[-1]}.csv"
    files.make(base)
    for name in files.names(base):
        files.drop(f"{base}/{name}")
    if not files.fs.rename(files.path(whole), files.path(target)):
        raise OSError(f"cannot rename to {target}")
    files.drop(staging)
    return base


def append_rows(df: DataFrame, path: str) -> None:
    """Append rows to a plain Parquet folder."""
    df.write.mode("append").parquet(path)
