"""What the operators of this subpackage share: the shared folder, written tables, Arrow helpers.

Lineage is cut by writing a table into the folder named by ``spark.checkpoint.dir``,
which the driver and all executors see. A folder of our own is used only where that
setting is absent and Spark runs on one machine (tests); on a cluster its absence is an error.

Written tables that a returned DataFrame reads must outlive the call. ``scratch`` removes all
that were written inside it, once its user has consumed the result; the rest goes when the
driver's process ends.
"""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_OWN_FOLDER: list[str] = []
#: Paths of written tables: of the process, then of every open scratch.
_SCOPES: list[list[str]] = [[]]

#: Rows of a narrow table that one file holds.
FILE_ROWS = 1 << 20

#: A run of what the contracts call a word between ASCII white space.
SPACE_WORD = r"[^\x20\x09-\x0D]+"
#: A run of ASCII letters, digits and anything beyond ASCII (A-Z not yet lower-cased).
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: Lower-cases A-Z and turns every ASCII byte that is no letter or digit into a blank.
ALNUM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _OWN_FOLDER:
            _OWN_FOLDER.append("file://" + tempfile.mkdtemp(prefix="pagewright-"))
        named = _OWN_FOLDER[0]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString().rstrip("/")  # with its scheme


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there belongs to the innermost scratch."""
    path = f"{shared_dir(spark)}/pagewright/{name}-{uuid.uuid4().hex}"
    _SCOPES[-1].append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table, through Spark's file system layer."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    for scope in _SCOPES:
        if path in scope:
            scope.remove(path)


def keep(path: str) -> None:
    """Hands a table written in the innermost scratch to the one around it."""
    if len(_SCOPES) > 1 and path in _SCOPES[-1]:
        _SCOPES[-1].remove(path)
        _SCOPES[-2].append(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Removes every table written inside, but for those given to ``keep``."""
    scope: list[str] = []
    _SCOPES.append(scope)
    try:
        yield
    finally:
        for path in list(scope):
            remove(spark, path)
        _SCOPES.remove(scope)


@atexit.register
def _remove_the_rest() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        for path in list(_SCOPES[0]):
            remove(spark, path)


def fresh_name(taken: list[str], name: str) -> str:
    """name, or with underscores after it if a column has that name (case does not tell columns apart)."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


@contextmanager
def shuffles_cleaned(spark: SparkSession) -> Iterator[None]:
    """Queries run inside drop their shuffle files as soon as each has ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before) if before is not None else spark.conf.unset(_CLEANUP)


def few_files(df: DataFrame, rows: int) -> DataFrame:
    """df, a table of a few numbers a row, in as few partitions as ``rows`` rows need.

    Every file that an executor writes to a local folder starts three processes (chmod of a folder, a file
    and its checksum), in each of which the executor's memory counts once more until it runs.
    """
    return df.repartition(max(1, math.ceil(rows / FILE_ROWS)))


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Writes df as a Parquet table into the shared folder and reads it back."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    with shuffles_cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def byte_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts hold about ``most`` bytes together."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = held = 0
    for row, length in enumerate(lengths):
        if row > start and held + length > most:
            yield batch.slice(start, row - start)
            start, held = row, 0
        held += length
    if start < batch.num_rows:
        yield batch.slice(start)


def array_slices(array: pa.Array, most: int = 1 << 20) -> Iterator[list[str]]:
    """The texts of an array, about ``most`` bytes at a time."""
    for part in byte_slices(pa.RecordBatch.from_arrays([array], ["text"]), "text", most):
        yield part.column(0).to_pylist()


def utf8(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    got = batch.column(column)
    if not pa.types.is_binary(got.type):
        got = got.cast(pa.binary())
    return [x or b"" for x in got.to_pylist()]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and text of the whole documents table."""
    return read_table(spark, sf_dir, "documents").select("doc_id", "text")


def crc_mod(column: str, n: int) -> "F.Column":
    """crc32 of a key as text, modulo n; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))
