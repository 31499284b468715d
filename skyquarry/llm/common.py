"""Helpers shared by the text operators.

Words are maximal runs of characters other than space and U+0009..U+000D, in Spark and in Python alike.
"""

from __future__ import annotations

import re
import sys
import tempfile
import uuid
import zlib
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space that separates words.
SPACES = " \t\n\x0b\f\r"
WORD_RE = re.compile(r"[^\x20\x09-\x0D]+")
#: Rows up to which a side may be broadcast, and salts used beyond it.
BROADCAST_ROWS = 100_000
SALTS = 32
A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ship(module: str) -> None:
    """Send a module's functions to executors by value, as they are in the driver. Broadcast models name their classes, so
    executors need the package on their path all the same."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see. Where it is unset, a local run gets a temporary one; a
    cluster, whose executors would each write to a disk of their own, an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = tempfile.mkdtemp(prefix="skyquarry-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it again: later plans start from files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _WRITTEN.append(path)
    if (own := _OWN.get()) is not None:
        own.append(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables that this driver has written, and those of the innermost own_tables() around the caller.
_WRITTEN: list[str] = []
_OWN: ContextVar[list[str] | None] = ContextVar("own_tables", default=None)


@contextmanager
def own_tables():
    """The list of paths that written() fills inside the block, in this thread; what other queries write meanwhile is not in it.

    An outer block's list gets them too when the block ends.
    """
    outer, own = _OWN.get(), []
    token = _OWN.set(own)
    try:
        yield own
    finally:
        _OWN.reset(token)
        if outer is not None:
            outer += own


def drop_tables(spark: SparkSession, paths: list[str]) -> int:
    """Delete these tables of written(), once results that read them are saved. Returns how many were there."""
    gone = list(paths)
    for x in gone:
        if x in _WRITTEN:
            _WRITTEN.remove(x)
    found = [spark._jvm.org.apache.hadoop.fs.Path(x) for x in gone]
    return sum(path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True) for path in found)


def drop_written(spark: SparkSession, since: int = 0, last: bool = True) -> int:
    """drop_tables() of all that this driver has written, by any query, after so many tables; last: the last one too."""
    return drop_tables(spark, _WRITTEN[since : len(_WRITTEN) if last else len(_WRITTEN) - 1])


def n_written() -> int:
    return len(_WRITTEN)


def with_uid(df: DataFrame, name: str = "uid") -> DataFrame:
    """A number for each row; only stable once written."""
    return df.withColumn(name, F.monotonically_increasing_id())


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once for each row, whatever reads them later.

    Filters and projections above are not merged into an explode of one struct, so they can't repeat its expressions.
    """
    rest = [F.col(f"`{c}`") for c in df.columns if c.lower() not in {k.lower() for k in columns}]
    one = F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items())))).alias("computed_")
    return df.select("*", one).select(*rest, *(F.col("computed_")[k].alias(k) for k in columns))


def carried(docs: DataFrame, **columns: str) -> DataFrame:
    """The whole row in one column doc_, beside the columns an operator works on, so that no names can clash.

    `.select("doc_.*")` brings the row back.
    """
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_"), *(F.col(f"`{c}`").alias(k) for k, c in columns.items()))


def lower_az(c: Column) -> Column:
    return F.translate(c, A_TO_Z, A_TO_Z.lower())


def lower_ascii(text: str) -> str:
    """A-Z to a-z, nothing else."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def words_of(text: str) -> list[str]:
    # str.split() also splits at other space characters; only texts that hold none may use it
    return WORD_RE.findall(text) if _OTHER_SPACES.search(text) else text.split()


#: What str.isspace() counts as space and WORD_RE does not.
_OTHER_SPACES = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def word_bytes(text: str) -> list[bytes]:
    """The words with A-Z lower-cased, in UTF-8: bytes.split() splits at just the six ASCII spaces."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def words_col(text: Column) -> Column:
    """Array of the words; empty for null and for texts without words."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[ \t-\r]+"))


def n_words_col(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, r"[ \t-\r]+"))).cast("long")


def crc_mod(doc_id: Column, k: int) -> Column:
    """crc32 of the id's decimal text modulo k; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % k


def py_crc_mod(doc_id, k: int) -> int | None:
    return None if doc_id is None else zlib.crc32(str(int(doc_id)).encode()) % k


def join_small(big: DataFrame, small: DataFrame, key: str, how: str = "left", spread: str | None = None) -> DataFrame:
    """Join a table that should be small, with one row for each key.

    Its rows are counted: up to BROADCAST_ROWS it is broadcast. Beyond, the small side is repeated for SALTS salts and
    the large one gets a salt from the column `spread`, so that a key with a third of the rows is in SALTS tasks. Without
    `spread`, for keys that few rows of big share, it is a plain shuffle. Spark's estimate of a salted side leaves the
    salts out, and files tell little of rows, so beyond BROADCAST_ROWS the hint keeps it from being broadcast.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, how)
    if not spread:
        return big.join(small.hint("merge"), key, how)
    salted = small.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")
    return big.withColumn("salt_", salt).join(salted.hint("merge"), [key, "salt_"], how).drop("salt_")


#: A key with more than one row in so many is hot; so there are no more hot keys than this.
HOT = 10_000


def join_hot(big: DataFrame, small: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Join two tables of any size, small with one row for each key, where a few keys may hold most rows of big.

    A small side of up to BROADCAST_ROWS is broadcast, as in join_small(). Beyond, the keys that hold more than 1/HOT of big's rows, which are HOT at most, are counted first and joined by broadcast; all
    others by a shuffle, in which no key holds more than that. Both sides should be written tables.
    """
    if small.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), key, how)
    total = big.count()
    hot = written(big.groupBy(key).agg(F.count("*").alias("n_")).filter(F.col("n_") * HOT > total).select(key), "hot-keys")
    few = small.join(F.broadcast(hot), key, "left_semi")
    return big.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(few), key, how).unionByName(big.join(F.broadcast(hot), key, "left_anti").join(small.hint("merge"), key, how))


def limited_batches(df: DataFrame, rows: int = 2000) -> DataFrame:
    """Set the rows in an Arrow batch, so that a batch of long texts stays small in a Python worker."""
    spark = df.sparkSession
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """(b): places -> 2**bits bits; Spark makes pieces of 32,768."""
    out = np.zeros(1 << (bits - 3), np.uint8)
    pieces = places.groupBy(F.bitmap_bucket_number(F.col("b") + 1).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("b") + 1)).alias("bits"))
    for r in pieces.toLocalIterator():
        begin = (r["at"] - 1) * 4096
        out[begin : begin + 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)[: len(out) - begin]
    return out


def has_bits(filter_: np.ndarray, places: np.ndarray) -> np.ndarray:
    return filter_[places >> 3] >> (places & 7).astype(np.uint8) & 1 > 0


def places_of_bits(h: np.ndarray, bits: int) -> np.ndarray:
    """Where hashes have their bits in a bitmap of 2**bits."""
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def rehash(h: np.ndarray) -> np.ndarray:
    """Another hash of a hash: filters look at two places."""
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
