"""What the operators share: the shared folder, mapped arrays, Arrow text helpers, column names."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text handled at once inside a Python worker; a single longer text is still taken whole.
SLICE_BYTES = 4 << 20
#: Arrays that a worker keeps mapped; each holds a file descriptor.
MOST_MAPPED = 384


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: spark.checkpoint.dir; where it is unset, one of our own, in local mode alone."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="palimpsest-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/palimpsest-{label}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """What a result may still read stays until the driver ends, and goes then."""
    fs, p = _hadoop(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)


def written(df: DataFrame, label: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: lineage ends there. It goes with drop_written() or the driver."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    delete_at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._palimpsest_path = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Deletes tables that written() made, once nothing reads them any more."""
    for df in tables:
        if path := getattr(df, "_palimpsest_path", None):
            delete_path(df.sparkSession, path)


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def named(columns: Iterable[str]) -> list[Column]:
    """Columns by their whole names, dots and blanks included."""
    return [F.col(quoted(c)) for c in columns]


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """Names for columns of our own that no column of the user's has, whatever the case."""
    used = {c.lower() for c in taken}
    return [next(n for k in range(len(used) + 1) if (n := f"_{w}" + "_" * k).lower() not in used) for w in wanted]


def text_of(name: str) -> Column:
    """A column as text; null is the empty text."""
    return F.coalesce(F.col(quoted(name)).cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else; lower() is the fast form wherever the text is ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def id_text(c: Column) -> Column:
    """An id as text; a null id is the empty text."""
    return F.coalesce(c.cast("string"), F.lit(""))


def running_sums(lengths: Column, part: int = 256) -> Column:
    """Sums of an array of BIGINT up to each place, summed by parts of `part` values, so that no step copies all that came before."""
    n, none = F.size(lengths), F.expr("cast(array() as array<bigint>)")
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0).cast("long"))
    add = lambda done, x: F.concat(done, F.array(last(done) + x))
    parts = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / part).cast("int")), lambda k: F.aggregate(F.slice(lengths, k * part + 1, part), none, add))
    # What comes before each part.
    before = lambda p: F.aggregate(p, F.array(F.lit(0).cast("long")), lambda done, x: F.concat(done, F.array(last(done) + last(x))))
    summed = F.transform(F.array(parts), lambda p: F.flatten(F.zip_with(p, F.slice(before(p), 1, F.size(p)), lambda own, base: F.transform(own, lambda x: x + base))))
    return F.when(n > 0, F.get(summed, 0)).otherwise(none)


def with_column(rows: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], out: str, kind: T.DataType, drop: int = 0) -> DataFrame:
    """mapInArrow for a function that leaves all columns of its batches (but the last `drop`) and adds one, whatever their names are: Spark's own takes no dots."""
    fields = rows.schema.fields[: len(rows.columns) - drop] + [T.StructField(out, kind)]
    names, plain = rows.columns, [f"c{k}" for k in range(len(fields))]

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(b.rename_columns(names) for b in batches):
            yield batch.rename_columns(plain)

    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(plain, fields, strict=True)])
    return rows.toDF(*[f"r{k}" for k in range(len(names))]).mapInArrow(renamed, schema).toDF(*[f.name for f in fields])


def store_of(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def write_array(folder: str, name: str, array: np.ndarray) -> None:
    """An array as a file of its own, under a passing name first: a task that runs again leaves the same file."""
    fs, path = store_of(folder)
    fs.create_dir(path, recursive=True)
    passing, final = f"{path}/.{name}-{os.getpid()}-{os.urandom(4).hex()}", f"{path}/{name}.npy"
    with fs.open_output_stream(passing) as f:
        np.lib.format.write_array(f, np.ascontiguousarray(array), allow_pickle=False)
    try:
        fs.move(passing, final)
    except OSError:
        # Some stores do not rename onto a file that is there; what is there came from the same rows.
        if fs.get_file_info(final).type != pa.fs.FileType.File:
            raise
        fs.delete_file(passing)


_mapped: OrderedDict[str, np.ndarray] = OrderedDict()


def read_array(folder: str, name: str) -> np.ndarray:
    """A mapped array. What a store cannot map is copied once for each executor, into its own folder that ends with the application."""
    key = f"{folder}/{name}"
    if key not in _mapped:
        fs, path = store_of(folder)
        path = f"{path}/{name}.npy"
        if not isinstance(fs, pa.fs.LocalFileSystem):
            local = os.path.join(SparkFiles.getRootDirectory(), os.path.basename(folder.rstrip("/")), f"{name}.npy")
            if not os.path.exists(local):
                os.makedirs(os.path.dirname(local), exist_ok=True)
                passing = f"{local}-{os.getpid()}"
                pa.fs.copy_files(path, passing, source_filesystem=fs)
                os.replace(passing, local)
            path = local
        while len(_mapped) >= MOST_MAPPED:
            _mapped.popitem(last=False)
        _mapped[key] = np.load(path, mmap_mode="r", allow_pickle=False)
    _mapped.move_to_end(key)
    return _mapped[key]


def release_memory() -> None:
    """Gives freed memory back: workers are used again, and what they hold on to counts against the executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def slices(batch: pa.RecordBatch, text: str, most: int = SLICE_BYTES) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Consecutive pieces of a batch with about `most` bytes of text each, never fewer than one row."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield at, batch.slice(at, to - at)
        at = to
    release_memory()


def texts_of(batch: pa.RecordBatch, text: str) -> pa.Array:
    """Texts without nulls in buffers of their own: some Arrow kernels misread what a cast makes of a slice."""
    return pc.fill_null(batch.column(text).cast(pa.large_string()), "").take(pa.array(np.arange(batch.num_rows)))


def blank_split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of A-Z lower-cased texts, and where each text's words start (one more at the end)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, offsets = lists.flatten(), np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.greater(pc.binary_length(words), 0), dtype=bool)
    before = np.concatenate(([0], np.cumsum(full)))
    return words.filter(pa.array(full)), before[offsets]


def joined(words: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray]:
    """All words with one space between, and where each word starts and ends there."""
    lengths = np.asarray(pc.binary_length(words), dtype=np.int64)
    ends = np.cumsum(lengths + 1) - 1
    buffers, first = words.buffers(), words.offset
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[first : first + len(words) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if len(words) else np.zeros(0, np.uint8)
    out = np.full(int(lengths.sum()) + max(0, len(words) - 1), 0x20, dtype=np.uint8)
    if len(words):
        gap = np.ones(len(out), dtype=bool)
        gap[ends[:-1]] = False
        out[gap] = data
    return out.tobytes(), ends - lengths, ends


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys in sorted rows."""
    keep: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([np.asarray(batch.column(c)) for c in keys], axis=1)
        cuts = [0, *(np.flatnonzero(np.any(k[1:] != k[:-1], axis=1)) + 1).tolist(), batch.num_rows]
        if last is not None and (k[0] != last).any():
            yield pa.Table.from_batches(keep)
            keep = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a:
                yield pa.Table.from_batches(keep)
                keep = []
            keep.append(batch.slice(a, b - a))
        last = k[-1]
    if keep:
        yield pa.Table.from_batches(keep)
