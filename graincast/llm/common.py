"""What the corpus operators share: scratch tables, small-side joins and SQL fragments."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as in the contracts' word pattern ``[^\x20\x09-\x0D]+``.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: A small side is broadcast up to this many bytes of values, as counted by ``value_bytes``.
BROADCAST_BYTES = 16 << 20
#: Copies of the small side, and so pieces of each key of the large side, beyond that bound.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only a local session gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="graincast-")
        spark.sparkContext.setCheckpointDir(base)
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/graincast-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends there and lost executors lose nothing."""
    return materialize_at(df, tag)[0]


def materialize_at(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``materialize``, and the path of the table."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop_path(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table whose readers are done, on any store Spark writes."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Rows that Python code holds as objects at a time.
SLICE_ROWS = 256


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of SLICE_ROWS rows: bounds what a worker holds, however many rows a batch has."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def merged(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """``run``, which gives a row for each row but in slices, with one batch for each batch it reads: the JVM side holds far less then."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: list[int] = []

        def fed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    sizes.append(batch.num_rows)
                    yield batch

        held: list[pa.RecordBatch] = []
        for part in run(fed()):
            held.append(part)
            if sum(p.num_rows for p in held) == sizes[0]:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held.clear()
                sizes.pop(0)

    return whole


#: Rows go to Python workers in Arrow batches of about so many bytes (a longer row is a batch alone) ...
BATCH_BYTES = 4 << 20
#: ... unless the session has this option at another value than Spark's own.
_BATCH_OPTION, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` in batches of BATCH_BYTES, which workers and the JVM hold several of. The option is read when the plan runs, so it stays set."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_OPTION) == _BATCH_DEFAULT:
        conf.set(_BATCH_OPTION, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def with_columns(names: Sequence[str], begin: Callable[[], Callable[[pa.RecordBatch], list[pa.Array]]], drop: Sequence[str] = ()) -> Callable:
    """For ``mapInArrow``: each batch with the columns ``names``, rid of ``drop``; what a task's ``begin`` returns gives them for each slice.

    Other columns aren't copied, and a batch is let go of before the next one is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = begin()
        for batch in batches:
            if batch.num_rows:
                made = [pa.concat_arrays(arrays) for arrays in zip(*map(make, slices([batch])), strict=True)]
                rest = [n for n in batch.schema.names if n not in drop]
                yield pa.RecordBatch.from_arrays([*(batch[n] for n in rest), *made], [*rest, *names])
                del made
            del batch

    return run


ROW = ("__graincast_file", "__graincast_row")


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with ROW, two numbers that tell its rows apart and are the same in every run over its files.

    They are the file's hash and the row's place in it; what isn't a plain scan of Parquet files is written first.
    """
    names = df.columns
    place = (F.xxhash64("_metadata.file_path").alias(ROW[0]), F.col("_metadata.row_index").alias(ROW[1]))
    try:
        return df.select(*[F.col(f"`{n}`") for n in names], *place)
    except AnalysisException:
        return numbered(materialize(df, "numbered"))


def value_bytes(df: DataFrame) -> int:
    """Bytes of all values in ``df``, from one aggregation."""

    def width(field: T.StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0)) + F.lit(16)
        if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.NumericType):
            return F.lit(8) * F.greatest(F.size(c), F.lit(0)) + F.lit(16)
        if isinstance(field.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)):
            return F.lit(8)
        return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))

    total = sum((width(f) for f in df.schema.fields), F.lit(0))
    return df.agg(F.sum(total.cast("long"))).first()[0] or 0


def join_small(big: DataFrame, small: DataFrame, key: str, spread: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``big`` left join ``small`` (nulls equal) on the column ``key`` that both have.

    ``small`` should be a scratch table. It is broadcast if its values fit in ``limit`` bytes. If they
    don't, both sides are shuffled with a salt: ``spread`` deals the rows of one key of ``big`` over SALTS
    tasks and ``small`` is repeated for each, so no key meets in one task.
    """
    other = small.withColumnRenamed(key, "__small_key")
    if value_bytes(small) <= limit:
        on = big[key].eqNullSafe(other["__small_key"])
        return big.join(F.broadcast(other), on, "left").drop("__small_key")
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    copies = other.withColumn("__small_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    on = salted[key].eqNullSafe(copies["__small_key"]) & (salted["__salt"] == copies["__small_salt"])
    return salted.join(copies, on, "left").drop("__small_key", "__small_salt", "__salt")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once although lambdas in ``body`` use it for each element."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def unit_hash(*parts: Column | str) -> Column:
    """A uniform double in (0, 1) from the first 52 bits of an MD5 over the parts: the same in any engine."""
    digest = F.md5(F.concat_ws("#", *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def unit_hash_sql(text: str) -> str:
    """``unit_hash`` in DuckDB's SQL; ``text`` is the joined key."""
    return f"((('0x' || substr(md5({text}), 1, 13))::BIGINT)::DOUBLE + 0.5) / {float(1 << 52)!r}"
