"""Shared pieces of the text operators: reading tables, shared scratch tables and Arrow mapping."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_ROOTS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only where none is set and Spark runs in one process, a temporary one of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_ROOTS:
        _OWN_ROOTS[app] = tempfile.mkdtemp(prefix="demeanor-")
        atexit.register(shutil.rmtree, _OWN_ROOTS[app], ignore_errors=True)
    return _OWN_ROOTS[app]


class Scratch:
    """Intermediate tables written to the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_root(spark)}/demeanor/{uuid.uuid4().hex}"
        self.made = 0
        self.held: list[tuple[DataFrame, str]] = []

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{self.made}-{name}"
        self.made += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.held.append((out, path))
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete the files of saved tables that nothing lazy refers to any more; other tables are left alone."""
        for path in [path for t, path in self.held if any(t is x for x in tables)]:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
        self.held = [(t, path) for t, path in self.held if not any(t is x for x in tables)]


def quoted(name: str) -> Column:
    """The column of exactly this name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def map_rows(
    df: DataFrame,
    columns: Sequence[str],
    schema: str,
    make: Callable[[], Callable[[list[list]], list[list]]],
    chunk_rows: int = 512,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The ``keep`` columns as they are, beside what a Python function makes of the named columns of every row.

    ``make()`` runs once in each task and returns a function from lists of column values to lists of
    output column values in the order of ``schema``. Batches are cut to ``chunk_rows`` rows, so that
    Python holds few texts at a time. A column of ``keep`` that has the name of one in ``schema`` is
    left out: the new one takes its place.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    made = _parse_datatype_string(schema)
    own = {c.lower() for c in made.names}
    keep = [c for c in keep if c.lower() not in own]
    width, arrow = len(columns), to_arrow_schema(made)
    kept = df.select(*map(quoted, keep)).schema
    names = [*(f"_k{k}" for k in range(len(keep))), *made.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, chunk_rows):
                part = batch.slice(at, chunk_rows)
                out = work([c.to_pylist() for c in part.columns[:width]])
                yield pa.RecordBatch.from_arrays([*part.columns[width:], *(pa.array(v, f.type) for v, f in zip(out, arrow))], names)

    source = df.select(*[quoted(c).alias(f"_c{k}") for k, c in enumerate(columns)], *[quoted(c).alias(f"_k{k}") for k, c in enumerate(keep)])
    fields = [type(f)(name, f.dataType) for name, f in zip(names, [*kept.fields, *made.fields])]
    done = source.mapInArrow(run, StructType(fields))
    return done.select(*[F.col(f"_k{k}").alias(c) for k, c in enumerate(keep)], *made.names)
