"""Helpers that several operators share: tables, shared storage, Arrow text batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of text that one numpy step handles; a longer single text is handled alone.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a temporary one of our own only where the master is local and the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"file://{tempfile.gettempdir()}/lexiweave-checkpoints"


def materialize(df: DataFrame, partitions: int | None = None, rows_per_file: int = 0) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, lost executors cost nothing. Rows of megabytes need files of few rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiweave-{uuid.uuid4().hex}"
    if partitions:
        df = df.coalesce(partitions)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of materialized tables that nothing will read again; others are left alone."""
    for df in tables:
        path = getattr(df, "scratch", None)
        if path:
            spark = df.sparkSession
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def numbered(docs: DataFrame) -> DataFrame:
    """A written table (row, kept): each row of docs as a struct with a number of its own, whatever the ids."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("kept")))


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(c.cast("string").cast("binary")) % n


def held_out(n: int, rest: int, doc_id: str = "doc_id") -> Column:
    """Whether the row never teaches: its crc32 modulo n is `rest`. A null id is held out, too."""
    return F.coalesce(crc_mod(doc_id, n) == rest, F.lit(True))


def carried(docs: DataFrame, keep: tuple[str, ...] | None = None) -> DataFrame:
    """(kept, text): columns of docs (all, or those named) as one struct, so that no name can clash with an operator's own."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in keep or docs.columns)).alias("kept"), F.col("text").cast("string").alias("text"))


def with_kept(rows: DataFrame, ddl: str) -> StructType:
    """The schema of `kept` as in rows, and the columns of `ddl` after it."""
    return StructType([rows.schema["kept"], *StructType.fromDDL(ddl).fields])


def beside(made: DataFrame, keep: tuple[str, ...], *names: str) -> DataFrame:
    """The columns `keep` of made.kept, and made's own `names`; of two with one name the operator's own stays."""
    return made.select(*(F.col(f"kept.`{c}`").alias(c) for c in keep if c not in names), *names)


def text_slices(col: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets in them) of at most `step` bytes, or one row.

    Null rows are empty. The bytes are a view of the Arrow buffer.
    """
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(col)
    if n == 0:
        return
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + step, "right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, body[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def batches(fn: Callable[[pa.RecordBatch], Iterator[dict] | dict | None], schema: pa.Schema):
    """A mapInArrow function from one that maps a batch to column dicts."""

    def run(it):
        for batch in it:
            out = fn(batch)
            if out is None:
                continue
            for cols in [out] if isinstance(out, dict) else out:
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, schema.field(k).type) for k, x in cols.items()], schema=schema)

    return run


def texts(col: pa.Array) -> list[str]:
    return [x or "" for x in col.to_pylist()]


def bounded_labels(labels: DataFrame, value: str, keep: Column, limit: int, salt: str) -> dict[int, int]:
    """At most `limit` labelled ids with their label, chosen by the smallest hash of the id.

    Rows with a null id or label are skipped; of repeated ids one label (the largest) stays.
    """
    rows = (
        labels.where(F.col("doc_id").isNotNull() & F.col(value).isNotNull() & keep)
        .groupBy("doc_id")
        .agg(F.max(value).cast("int").alias("label"))
        .orderBy(F.xxhash64(F.lit(salt), "doc_id"), "doc_id")
        .limit(limit)
        .toArrow()
    )
    return dict(zip(rows["doc_id"].to_pylist(), rows["label"].to_pylist(), strict=True))
