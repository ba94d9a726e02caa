"""Mixing sources to target weights by repetition rates.

Tokens are added up per source, each source gets a target by weight with a cap, and its documents are emitted floor(rate) times plus one
seeded Bernoulli copy with the fraction as probability. Only DataFrame functions are used. The text is never shuffled: the per-source
table is written once, so Spark knows its true size and broadcasts it only below the session's own threshold.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from carrierlake.session import cut_lineage

from .common import documents, query, spaced_words, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: One SHA-256 per document gives eight independent 32-bit draws.
SEEDS = 8


def draws(key: Column) -> list[Column]:
    """Eight numbers in [0, 1) that depend on the key alone."""
    digest = F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("double") / F.lit(4294967296.0) for i in range(SEEDS)]


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from rows (source, size).

    Sources in code point order, null last, take the weights in turn. A target stops at ``most`` times its source's size and the excess
    goes to the others by weight; the end of that process is min(most * size, weight * level) for the one level that uses up the total,
    found from the sources ordered by cap / weight. One row per source reaches the two ordered windows.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    ranked = totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(most))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    levels = ranked.withColumn("level", level).withColumn("place", F.row_number().over(rising))
    free = F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.struct("place", "level"))
    common = F.min(free).over(every)["level"]  # the first source that stays below its cap
    target = F.least(F.col("cap"), F.coalesce(F.col("weight") * common, F.col("cap")))
    return levels.select("source", "source_size", target.alias("target"))


def copies(rate: Column, draw: Column) -> Column:
    """floor(rate), and one more with the fraction as probability."""
    return (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int")


def mixing_rates(sizes: DataFrame, **options) -> DataFrame:
    """(source, source_size, target, rate, seed) from rows (doc_id, source, size).

    Of the eight draws a document has, each source uses the one whose total comes nearest its target (ties: the first), which takes
    most of the sampling noise out of sources with few or very long documents.
    """
    targets = source_targets(sizes, **options)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    targets = cut_lineage(targets.withColumn("rate", rate))
    joined = sizes.alias("s").join(targets.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")))
    sums = [F.sum(F.col("size") * copies(F.col("rate"), u)).alias(f"taken_{i}") for i, u in enumerate(draws(F.col("doc_id")))]
    taken = joined.groupBy("t.source", "source_size", "target", "rate").agg(*sums)
    gaps = F.array(*[F.abs(F.col(f"taken_{i}") - F.col("target")) for i in range(SEEDS)])
    seed = (F.array_position(gaps, F.array_min(gaps)) - 1).cast("int")
    return cut_lineage(taken.select("source", "source_size", "target", "rate", seed.alias("seed")))


def with_copies(rows: DataFrame, rates: DataFrame) -> DataFrame:
    """Rows (doc_id, source, ...) with source_size, target and the number of copies."""
    r = rates.select(F.col("source").alias("rate_source"), "source_size", "target", "rate", "seed")
    chosen = F.element_at(F.array(*draws(F.col("doc_id"))), F.col("seed") + 1)
    return (
        rows.join(r, F.col("source").eqNullSafe(F.col("rate_source")))
        .withColumn("copies", copies(F.col("rate"), chosen))
        .drop("rate_source", "rate", "seed")
    )


def document_sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.size(spaced_words(text_of())).cast("long").alias("size"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The documents, each as often as the mix takes it, with the columns of the input.

    Null source is a source of its own; null or empty text has size 0 and follows its source's rate; equal rows with one doc_id are drawn
    alike; an empty table gives an empty table. Columns of any other name pass through.
    """
    rates = mixing_rates(cut_lineage(document_sizes(docs)), **options)
    whole = docs.select("doc_id", "source", F.struct(*docs.columns).alias("row"))
    taken = with_copies(whole, rates).where(F.col("copies") > 0)
    return taken.select(F.explode(F.array_repeat(F.col("row"), F.col("copies"))).alias("row")).select("row.*")


ORACLE = r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight,
  source_size * 2.0::DOUBLE AS cap FROM totals),
levels AS (SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER w, 0.0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0.0)) AS level,
  row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS place FROM ranked
  WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size,
  least(cap, coalesce(weight * (SELECT arg_min(level, place) FROM levels WHERE cap / weight >= level), cap)) AS target FROM levels),
rates AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets),
drawn AS (SELECT doc_id, size, r.*, i, (floor(rate) + CASE WHEN ('0x' || substr(sha256(coalesce(doc_id::VARCHAR, '')), (8 * i + 1)::INT, 8))::BIGINT
  / 4294967296.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies
  FROM sized s JOIN rates r ON s.source IS NOT DISTINCT FROM r.source CROSS JOIN range(8) t(i)),
gaps AS (SELECT source, i, abs(sum(size * copies) - any_value(target)) AS gap FROM drawn GROUP BY source, i),
best AS (SELECT source, arg_min(i, (gap, i)) AS seed FROM gaps GROUP BY source)
SELECT doc_id, size, source_size, target, size * copies AS taken FROM drawn d JOIN best b
  ON d.source IS NOT DISTINCT FROM b.source AND d.i = b.seed
"""


@query("op10_mixing", ORACLE)
def op10(spark, folder):
    sizes = cut_lineage(document_sizes(documents(spark, folder)))
    taken = with_copies(sizes, mixing_rates(sizes))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
