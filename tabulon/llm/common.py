"""What several operators here share: tables, checkpoints and text columns computed in Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Words are runs of anything but ASCII white space, everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; where a local session names none, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tabulon-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``df`` without columns that an operator is about to add: an operator's own columns win over clashing ones."""
    return df.drop(*names)


def with_text_columns(
    df: DataFrame,
    text: str,
    fields: Sequence[T.StructField],
    compute: Callable[[list[str | None]], Sequence[Sequence]],
    keep: Sequence[str],
) -> DataFrame:
    """Columns ``keep`` of ``df`` and then ``fields``, computed from whole texts an Arrow batch at a time.

    ``compute`` takes the texts of a batch and returns one sequence per field. Nothing is shuffled.
    """
    kept = [c for c in keep if c not in {f.name for f in fields}]
    schema = T.StructType([df.schema[c] for c in kept] + list(fields))
    arrow = to_arrow_schema(schema)
    types = [arrow.field(f.name).type for f in fields]
    source = df.select(*kept, F.col(text).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(batch.column(len(kept)).to_pylist())
            columns = [batch.column(i) for i in range(len(kept))]
            columns += [x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return source.mapInArrow(run, schema)
