"""Words, rows carried whole, and the registry of this subpackage."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SPACED_WORD = r"[^\x20\x09-\x0D]+"
NON_SPACE = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def query(name: str, sql: str | None = None):
    """Register a (spark, folder) plan and, when SQL can express it, its oracle."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_of(column: str = "text") -> Column:
    """The text, empty where null."""
    return F.coalesce(F.col(column), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays (``lower`` would change letters of other scripts)."""
    return F.translate(text, UPPER, UPPER.lower())


def spaced_words(text: Column) -> Column:
    """Stretches without ASCII white space, in order."""
    return F.regexp_extract_all(text, F.lit(SPACED_WORD), F.lit(0))


def hashed_sample(rows: DataFrame, n: int) -> DataFrame:
    """At most n rows, those of the smallest hash of all their columns.

    Hashes are uniform, so a bound on them leaves little more than n rows before any row moves; only those are ordered.
    """
    total = max(rows.count(), 1)
    share = 1.25 * n / total + 50 / total
    key = F.xxhash64(*rows.columns)
    if share < 1:
        rows = rows.where(key < F.lit(int(-(2**63) + share * 2**64)))
    return rows.orderBy(key).limit(n)


def bounded_sample(rows: DataFrame, n: int) -> DataFrame:
    """The n rows of the smallest hash of all their columns, all rows if there are fewer.

    Rows per hash range are counted first (65,536 counts), so only ranges that hold the result are ordered, at any size.
    """
    key = F.xxhash64(*rows.columns)
    place = F.shiftrightunsigned(key, 48)
    kept, last = 0, -1
    for r in sorted(rows.groupBy(place.alias("place")).count().collect()):
        if kept >= n:
            break
        kept, last = kept + r[1], r.place
    smallest = rows.where(place <= last)
    return smallest.orderBy(place, key, *rows.columns).limit(n)
