"""Text helpers, training remainders, stored steps and numpy tokens shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenspan.plans.checkpoints import work_dir
from lumenspan.session import configure, ship

#: A word for the operators that split at ASCII white space, as Java and RE2 spell it.
WORD = r"[^\x20\x09-\x0D]+"
#: ASCII characters other than letters and digits.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of an Arrow batch: documents of a megabyte still make batches that fit a worker.
BATCH_ROWS = 256
#: Size up to which Spark may broadcast a table unasked.  It guesses sizes from files and columns, without the rows that an
#: explode adds: under its default of 10 MB, tables of many million rows went through the driver.
BROADCAST_BYTES = 256 << 10


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the library, small Arrow batches and broadcasts, and the package on the executors."""
    configure(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", str(BROADCAST_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    ship(spark)
    return spark


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, UPPER.lower())


def alnum_words(text: Column) -> Column:
    """Maximal runs of ASCII letters, digits and characters beyond ASCII."""
    return F.array_remove(F.split(text, NOT_ALNUM), "")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows written once to the shared work folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    folder = work_dir(spark, label)
    df.write.parquet(folder)
    out = spark.read.schema(df.schema).parquet(folder)
    out.stored_in = folder
    return out


def discard(df: DataFrame) -> None:
    """Remove what ``stored`` wrote, once nothing that still runs reads it."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_in)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: A key with more than this share of the rows is frequent: there are fewer than a thousand of them.
FREQUENT = 0.001


def looked_up(rows: DataFrame, table: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Rows joined with a table that has each value of the key column at most once; both are read twice.

    All rows of a very frequent key would meet in one task.  Frequent keys are found in one pass of bounded
    memory (a superset of those with over a thousandth of the rows); their entries, so at most about a thousand,
    are broadcast, and the rows of all other keys are joined by a shuffle.
    """
    found = rows.where(F.col(key).isNotNull()).stat.freqItems([key], FREQUENT).first()[0]
    if not found:
        return rows.join(table, key, how)
    often = F.coalesce(F.col(key).isin(found), F.lit(False))
    hot = rows.where(often).join(F.broadcast(table.where(F.col(key).isin(found))), key, how)
    return hot.unionByName(rows.where(~often).join(table, key, how))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Characters that are not part of an alphanumeric word.
APART = np.zeros(256, bool)
APART[:0x80] = True
for _range in (range(48, 58), range(65, 91), range(97, 123)):
    APART[list(_range)] = False

_RANDOM = np.random.Generator(np.random.PCG64(20240917))
_VALUE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def joined(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, A-Z lower-cased, a line end after each, and the start of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts = np.cumsum([0] + [len(r) + 1 for r in raw])[:-1]
    return LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)], starts


def word_hashes(data: np.ndarray, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and 64-bit hash of every word of the bytes; words are runs of bytes that are not apart."""
    gap = apart[data]
    before = np.empty_like(gap)
    before[0], before[1:] = True, gap[:-1]
    starts = np.flatnonzero(~gap & before)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    inside = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else None
    if inside is None:
        inside = np.zeros(len(data), np.int64)
        inside[starts[0] :] = np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))
    longest = int(inside[~gap].max()) + 1
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(longest, _FACTOR, np.uint64))
        values = _VALUE[data] * powers[np.minimum(inside, longest - 1)]
        values[gap] = 0
        return starts, mix(np.add.reduceat(values, starts))


def pieces(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most limit characters together; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or "")
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
