"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: One bytes.translate call lower-cases A-Z and turns every ASCII byte that is no digit or letter into a space.
#: Bytes from 0x80 on stay: they belong to words.
WORD_TABLE = bytes(
    (c + 32 if 65 <= c <= 90 else c) if (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) else 32
    for c in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a UTF-8 text, as bytes."""
    return text.translate(WORD_TABLE).split() if text else []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """A string column as UTF-8 bytes, without decoding."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()


def crc_bucket(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(modulus))


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """glibc's call that hands free pages back to the system; None with another C library."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (AttributeError, OSError):
        return None


def settled(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow; at a task's end its worker, which Spark uses again, gives free memory back."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := _trim():
                trim(0)

    return each


def named(name: str) -> Column:
    """The column of exactly that name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def clashing(names: Iterable[str], new: Iterable[str]) -> list[str]:
    """Those names that Spark can't tell from new ones: equal but for case."""
    low = {n.lower() for n in new}
    return [n for n in names if n.lower() in low]


def beside(names: Iterable[str], new: Iterable[str]) -> list[str]:
    """Those names that stay beside new columns."""
    names = list(names)
    gone = set(clashing(names, new))
    return [n for n in names if n not in gone]


def unused(df: DataFrame, *stems: str) -> list[str]:
    """Names that no column of ``df`` has, one for each stem."""
    taken, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


#: Keys with more rows than this share of all are joined by broadcast: there are at most this many of them.
HOT_KEYS = 1000


def join_by_key(rows: DataFrame, known: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """``rows`` (``total`` of them) joined with ``known``, which has one row for each key and in ``n`` how many rows it has.

    A key with more than a thousandth of all rows would keep one task busy; of such keys there are a thousand at most, so
    they are broadcast. All others are joined by shuffle. ``rows`` is read twice and should be checkpointed; what makes
    ``known`` is shuffled once and used again.
    """
    hot = known.filter(F.col(n) * HOT_KEYS > total).drop(n)
    often = rows.join(F.broadcast(hot), keys)
    seldom = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return often.unionByName(seldom.join(known.filter(F.col(n) * HOT_KEYS <= total).drop(n), keys))


def append_columns(
    df: DataFrame,
    fields: list[T.StructField],
    rows: Callable[[], Callable[[pa.RecordBatch], list[pa.Array] | tuple[list[pa.Array], pa.Array]]],
    keep: Iterable[str] | None = None,
    inputs: Iterable[str] = (),
) -> DataFrame:
    """Pass batches through Python and add the columns ``fields``.

    ``rows()`` runs once in each task and returns the function for its batches, which gives the new columns, or those
    and a mask of the rows that stay. ``keep`` names the columns of ``df`` that stay (None: all); ``inputs`` are read
    but need not stay. A column of ``df`` named like a new one, be it but for case, gives way to it.
    """
    keep = beside(df.columns if keep is None else keep, [f.name for f in fields])
    inner = {c: f"__in_{i}" for i, c in enumerate(dict.fromkeys([*keep, *inputs]))}
    source = df.select(*[named(c).alias(a) for c, a in inner.items()])
    made = [T.StructField(f"__out_{i}", f.dataType, f.nullable) for i, f in enumerate(fields)]
    schema = T.StructType([*(source.schema[inner[c]] for c in keep), *made])
    arrow = to_arrow_schema(schema)
    names = {a: c for c, a in inner.items()}
    stay = [inner[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = rows()
        for batch in batches:
            named = batch.rename_columns([names[n] for n in batch.schema.names])
            made = each(named)
            made, mask = made if isinstance(made, tuple) else (made, None)
            columns = [batch.column(batch.schema.get_field_index(s)) for s in stay]
            out = pa.RecordBatch.from_arrays(
                [c.cast(f.type) for c, f in zip([*columns, *made], arrow, strict=True)], schema=arrow
            )
            yield out.filter(mask) if mask is not None else out

    return source.mapInArrow(settled(run), schema).select(
        *[F.col(inner[c]).alias(c) for c in keep], *[F.col(m.name).alias(f.name) for m, f in zip(made, fields, strict=True)]
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; on one machine, where none is named, one in the warehouse.

    A cluster without the setting is refused: the default warehouse is a folder of one machine there.
    """
    named_folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named_folder:
        return named_folder
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/checkpoints"


#: Documents, or rows made of so many documents, of one file of a checkpoint.
FILE_ROWS = 20_000


def few_files(df: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """``df`` in no more partitions than so many rows are worth, though one for each core.

    Every file of a checkpoint has its cost, however small it is: a request to a store, or for Spark's local file system a
    process that is started to set its permissions.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism if each == FILE_ROWS else 1, 1 + rows // each))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder, so that results survive lost executors.

    With spark.cleaner.referenceTracking.cleanCheckpoints Spark deletes the files once the result is no longer used.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
