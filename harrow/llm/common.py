"""What the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes other than words: for words of ASCII letters, digits and all other code points, A-Z lowered.
WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)


#: Characters or items of an output batch.
MOST_BATCH = 1_000_000


def alnum_words(text: str) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lowered, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split()


def space_words(text: str) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered, as UTF-8. bytes.split knows just these."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def id_text(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """The id and the whole text, null as empty, under names that no further column can clash with."""
    return [F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")]


#: What a Python worker keeps from task to task: of one operator at a time, so that a chain of operators does not add up.
_KEPT: dict[str, dict] = {}


def kept(owner: str, key, make: Callable):
    """The worker's object ``key`` of an operator, made when it is first asked for."""
    forget_others(owner)
    own = _KEPT.setdefault(owner, {})
    if key not in own:
        own[key] = make()
    return own[key]


def forget_others(owner: str) -> None:
    others = [o for o in _KEPT if o != owner]
    for o in others:
        del _KEPT[o]
    if others:
        gc.collect()


def give_back() -> None:
    """Return memory that a task has freed to the system; a worker that is used again would hold it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library than glibc


def map_rows(frame: DataFrame, rows: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, per_batch: int = 2000) -> DataFrame:
    """``rows`` turns an iterator over a partition's rows into one over result rows.

    Arrow batches are read and written in turn, so a worker holds one batch of input and one of output,
    whatever the size of the partition. Spark bounds the input's bytes; an output batch ends at
    ``per_batch`` rows, or at MOST_BATCH characters or items where ``per_batch`` is not set for short rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow, weighed = to_arrow_schema(_parse_datatype_string(schema)), per_batch <= 2000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given():
            for b in batches:
                columns = b.columns
                for at in range(0, b.num_rows, 256):
                    yield from zip(*(c.slice(at, 256).to_pylist() for c in columns), strict=True)

        def batch(held):
            columns = zip(zip(*held, strict=True), arrow, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in columns], schema=arrow)

        forget_others(owner)
        held, size = [], 0
        for row in rows(given()):
            held.append(row)
            if weighed:
                size += sum(len(x) for x in row if isinstance(x, (str, bytes, list)))
            if len(held) >= per_batch or size >= MOST_BATCH:
                yield batch(held)
                held, size = [], 0
        if held:
            yield batch(held)
        held.clear()
        give_back()

    owner = rows.__module__
    return frame.mapInArrow(run, schema)


def fresh(frame: DataFrame, *stems: str) -> list[str]:
    """For each stem a column name that the frame does not have, whatever its case."""
    taken, out = {c.lower() for c in frame.columns}, []
    for stem in stems:
        while stem.lower() in taken:
            stem += "_"
        taken.add(stem.lower())
        out.append(stem)
    return out


def quoted(name: str) -> str:
    """A column name as it is referred to, whatever its characters."""
    return "`" + name.replace("`", "``") + "`"


def bounded(frame: DataFrame, row_bytes: int, most_bytes: int) -> DataFrame:
    """The frame, marked for broadcast if a count shows that its rows, of ``row_bytes`` each, fit in ``most_bytes``."""
    most = most_bytes // row_bytes
    return F.broadcast(frame) if frame.limit(most + 1).count() <= most else frame


def ddl(frame: DataFrame) -> str:
    """The frame's columns as a schema string."""
    return ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in frame.schema.fields)


#: Bytes of an input batch; Spark's own bound is eight times that, in the JVM and again in each worker.
INPUT_BATCH = "8m"


def ship(spark: SparkSession) -> None:
    """Let Python workers that start from now on import this package from where the driver has it.

    Their Arrow batches are kept small, unless the session has a bound of its own.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, "64m") in ("67108864b", "64m"):
        spark.conf.set(key, INPUT_BATCH)
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [root, env.get("PYTHONPATH", "")]))


def _own_folder(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``, which all executors share. Set that only where it is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not top:
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    return f"{top.rstrip('/')}/harrow_{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}"


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Delete all tables that ``written`` has made in this application, once no lazy result reads them any more.

    Operators drop what they need no longer; what their results are read from stays until this call.
    """
    _delete(spark, _own_folder(spark))


def written(frame: DataFrame) -> DataFrame:
    """The frame as a Parquet table in the shared folder: its lineage ends there, and lost executors cost nothing.

    An aggregate that is joined on its own key is written first, too: Spark only splits the large
    partitions of a join if both sides come straight from an exchange.
    """
    spark = frame.sparkSession
    folder = shared_folder(spark)
    frame.write.parquet(folder)
    return spark.read.schema(frame.schema).parquet(folder)


def drop_written(*frames: DataFrame) -> None:
    """Delete the files of tables that ``written`` made, once nothing reads them any more."""
    for frame in frames:
        for folder in {f.rsplit("/", 1)[0] for f in frame.inputFiles()}:
            _delete(frame.sparkSession, folder)
