"""What the operators of this package share: Arrow batch plumbing, the shared
scratch folder, word tables."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: A-Z to a-z, all other bytes unchanged.
ASCII_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cases A-Z; every byte that is not 0-9, a-z or above 0x7F becomes a space.
ALNUM_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share. It comes from
    ``spark.checkpoint.dir``; only where that is unset and all runs in one
    process (tests) one is made."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="scratch-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage with a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of what has been written and dropped:
    its cleaner acts when the JVM collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Bytes that an Arrow batch may have before another row is put into it.
BATCH_BYTES = 8 << 20


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Texts may be long: batches are bounded by bytes, and by fewer rows than
    Spark's 10,000. Spark reads these settings when a plan runs, so they stay set
    in the session; a smaller setting of the user's stays as it is."""
    settings = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    for key, most in settings.items():
        number, unit = re.fullmatch(r"(-?\d+)([a-z]*)", spark.conf.get(key).lower()).groups()
        if not 0 < int(number) * 1024 ** "bkmgtp".find(unit[:1] or "b") <= most:
            spark.conf.set(key, str(most))


#: Keys with one row in so many, or more, are dealt over several tasks if they have DEALT rows at least.
HOT_KEYS, DEALT = 1024, 256


def joined_to_classes(rows: DataFrame, classes: DataFrame, key: str, n: str, spread: Column) -> DataFrame:
    """Rows joined to the class of their key. ``classes`` is a written table
    with one row for each key and, in ``n``, the number of rows that have it.
    Rows of a hot key are dealt by ``spread``, a number of the row, to copies of
    its class. As the ``n`` add up to all rows, no more than HOT_KEYS keys can be
    hot; only these are broadcast."""
    share = max((classes.agg(F.sum(n)).first()[0] or 0) // HOT_KEYS + 1, DEALT)
    deals = F.ceil(F.col(n) / share).cast("int")
    hot = classes.where(F.col(n) > share).select(key, deals.alias("__deals"))
    own = F.pmod(F.coalesce(spread, F.lit(0)), F.coalesce("__deals", F.lit(1))).cast("int")
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__deal", own).drop("__deals")
    copies = classes.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.greatest(deals, F.lit(1)) - 1)))
    return dealt.join(copies, [key, "__deal"]).drop("__deal")


def octets(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist() if len(column) else []


def appended(
    df: DataFrame,
    fields: list[StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list]],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """``df`` with columns computed batch by batch in Python. ``make`` runs once
    in each task and gives the function from a batch to the new columns. Input
    columns that have a new column's name (in any case) are replaced, those in
    ``drop`` are read but not returned."""
    small_batches(df.sparkSession)
    plain = {n: f"__dotted{k}" if "." in n or "`" in n else n for k, n in enumerate(df.columns)}
    back = {safe: n for n, safe in plain.items()}
    df = df.toDF(*plain.values())  # mapInArrow resolves columns by name
    gone = {f.name.lower() for f in fields} | {x.lower() for x in drop}
    keep = [f.name for f in df.schema.fields if f.name.lower() not in gone]
    schema = StructType([df.schema[n] for n in keep] + fields)
    names = keep + [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), *each(batch)], names=names)

    return df.mapInArrow(run, schema).toDF(*(back.get(n, n) for n in names))


def remainder(column: str, n: int):
    """crc32 of the id as text, modulo n. A null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))
