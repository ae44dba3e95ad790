"""Shared pieces of the training-data operators: word definition, stored
intermediate tables, size-checked joins and column-name hygiene."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a maximal run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a broadcast side may have at most; a larger side is joined by shuffle.
BROADCAST_ROWS = 50_000

#: Bits of a bit table for each value in it, and the most that it has (16 MB).
BITS, MOST_BITS = 16, 1 << 27

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns of these names, whatever their case: an operator's
    output column replaces an input column of the same name."""
    drop = {n.lower() for n in names}
    kept = [c for c in df.columns if c.lower() not in drop]
    return df if len(kept) == len(df.columns) else df.select(*[F.col(f"`{c}`") for c in kept])


#: One column holds all of an operator's input columns, so that none can clash with
#: the names that it uses itself.
_IN = "__in"


def packed(df: DataFrame, out: tuple[str, ...], **named: Column) -> DataFrame:
    """The named columns, made from df's, and one struct of all of df's columns but
    those that `out` names."""
    kept = without(df, *out).columns
    return df.select(*[v.alias(k) for k, v in named.items()], F.struct(*[F.col(f"`{c}`") for c in kept]).alias(_IN))


def unpacked(df: DataFrame, like: DataFrame, out: tuple[str, ...]) -> DataFrame:
    """The columns of `like` but those that `out` names, and those of df that it
    names."""
    return df.select(*[F.col(f"{_IN}.`{c}`").alias(c) for c in without(like, *out).columns], *out)


def n_words(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def work_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: what the cluster names in
    spark.checkpoint.dir, or, where that is unset on a single machine (tests), a
    temporary folder that the setting then names. A cluster without the setting
    has no folder that all its machines see: that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = "file://" + tempfile.mkdtemp(prefix="tidewater-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def small(batches, rows: int = 1000):
    """Arrow batches in slices of few rows: what is made of one at a time stays
    small, however many rows Spark sends."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def grouped(batches, key: list[str]):
    """Runs of rows with equal key in batches that are sorted by it, as tables."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t]).combine_chunks()
        change = np.zeros(t.num_rows - 1, bool)
        for c in key:
            v = t.column(c).to_numpy(zero_copy_only=False) if pa.types.is_primitive(t.column(c).type) else np.array(t.column(c).to_pylist(), object)
            change |= v[1:] != v[:-1]
        at = [0, *(np.flatnonzero(change) + 1).tolist()]
        for a, b in zip(at, at[1:]):
            yield t.slice(a, b - a)
        rest = t.slice(at[-1])
    if rest is not None:
        yield rest


#: With it, Spark deletes a query's shuffle files when the query has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch while a table is stored: texts are long, and a batch stands in
#: the executor's memory twice, beside the JVM and in its Python worker.
_ARROW, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet under the work folder and reads it back: cuts the
    lineage, is computed once and outlives any executor. The shuffle files of the
    writing go with it."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/tidewater/{tag}-{uuid.uuid4().hex}"
    rows = int(spark.conf.get(_ARROW))
    during = {_CLEANUP: "true", _ARROW: str(min(rows, ARROW_ROWS) if rows > 0 else ARROW_ROWS)}
    before = {_CLEANUP: spark.conf.get(_CLEANUP, "false"), _ARROW: str(rows)}
    try:
        for key, value in during.items():
            spark.conf.set(key, value)
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(df: DataFrame) -> None:
    """Deletes a stored table that no later plan reads."""
    for i, (spark, path) in enumerate(_written):
        if path == df._stored_at:
            _delete(spark, path)
            del _written[i]
            return


def mark() -> int:
    """Where the tables stand that are stored from now on; see discard_since."""
    return len(_written)


def discard_since(place: int, *kept: DataFrame) -> None:
    """Deletes the tables stored since mark(), but those kept: what was made of the
    others is stored by now."""
    stay = {df._stored_at for df in kept}
    for spark, path in _written[place:]:
        if path not in stay:
            _delete(spark, path)
    _written[place:] = [x for x in _written[place:] if x[1] in stay]


def release() -> None:
    """Deletes the intermediate tables written so far. Call it once their
    readers' results are written."""
    while _written:
        spark, path = _written.pop()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session has ended: nothing can be deleted
            return


atexit.register(release)


def bit_table(values: DataFrame):
    """A bit table of few or many values (value long), broadcast: a value's low bits
    are its place. Its size follows the values up to MOST_BITS; beyond, more of what
    is not among the values passes, and nothing is lost. Only the bits are sent to
    the driver."""
    bits = min(max(1 << 16, 1 << (BITS * values.count()).bit_length()), MOST_BITS)
    place = F.col("value").bitwiseAND(bits - 1)
    words = values.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, CAST((value & {bits - 1}) % 64 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("bit").to_numpy()
    return values.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def in_table(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of the values (uint64) may be in a bit table."""
    at = (values & np.uint64(8 * len(table) - 1)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def join_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", salts: int = 16, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a table of few rows, unique in `on`, to a large one whose keys may
    be hot. It is broadcast if it has at most `limit` rows (counted first);
    else its rows are repeated for each of `salts` salts and the large side's
    rows dealt over them, so that no key's rows meet in one task."""
    if small.limit(limit + 1).count() <= limit:
        return big.join(F.broadcast(small), on, how)
    salted = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    # maps have no hash; a row's salt must be the same whenever it is made again
    plain = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    rest = [plain(f) for f in big.schema.fields if f.name not in on][:8]
    dealt = big.withColumn("__salt", F.pmod(F.xxhash64(*rest) if rest else F.lit(0).cast("long"), F.lit(salts)).cast("int"))
    return dealt.join(salted, [*on, "__salt"], how).drop("__salt")
