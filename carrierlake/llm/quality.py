r"""Quality rules with host verdicts.

Counts per document, hard and soft rules, failures added up per host, rates drawn towards an empirical beta prior, and host verdicts
joined back. Only DataFrame functions are used; repeated windows are found inside a row by sorting, so no window is ever shuffled.
"""

from pyspark.sql import Column, DataFrame, functions as F

from carrierlake.session import cut_lineage

from .common import NON_SPACE, documents, query, spaced_words, text_of

#: Soft rules. One alone never rejects a document; it does on a host whose shrunk failure rate is surely over the prior's mean.
SOFT_REPEATS = 30  # per cent of words in repeated windows
SOFT_SYMBOLS = 10  # symbols per 100 words
SOFT_LINES = 3  # repeated lines
SOFT_WORD = (2.0, 15.0)  # mean characters of a word
HOST_Z = 1.28  # posterior standard deviations that "surely" asks for, one side, about nine in ten


def counted(docs: DataFrame, width: int = 3) -> DataFrame:
    """The columns of docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words.

    Windows are compared by a 64-bit hash chained over their words. A text has at most a few hundred thousand windows, so two different
    ones meet with a chance below 1e-8 a text; everything else is exact. Null text counts as empty, and both give zeros.
    """
    text = text_of("_text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stage = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"))
    stage = stage.select("_row", "_text", spaced_words(text).alias("_words"), lines.alias("_lines"))
    window = lambda word, i: F.xxhash64(word, *[F.get(F.col("_words"), i + k) for k in range(1, width)])
    stage = stage.select(
        "_row",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace(text, NON_SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.regexp_replace(text, r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.slice(F.transform("_words", window), 1, F.greatest(F.size("_words") - (width - 1), F.lit(0))).alias("_windows"),
    )
    stage = stage.withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    ordered = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    stage = stage.withColumn("_ordered", F.when(F.col("_repeats"), ordered)).drop("_windows")
    same = lambda x, i: F.coalesce(F.get(F.col("_ordered"), i)["h"] == x["h"], F.lit(False))
    again = F.filter("_ordered", lambda x, i: same(x, i + 1) | ((i > 0) & same(x, F.greatest(i - 1, F.lit(0)))))
    stage = stage.withColumn("_starts", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("_ordered")
    gap = lambda at, i: F.least(F.lit(width), F.coalesce(F.get(F.col("_starts"), i + 1) - at, F.lit(width)))
    covered = F.aggregate(F.transform("_starts", gap), F.lit(0), lambda total, x: total + x)
    stage = stage.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_starts", "_repeats")
    return stage


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def soft_failed() -> Column:
    mean = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return (
        (100 * F.col("n_repeat_words") > SOFT_REPEATS * F.col("n_words"))
        | (100 * F.col("n_symbols") > SOFT_SYMBOLS * F.col("n_words"))
        | (F.col("n_dup_lines") >= SOFT_LINES)
        | ~mean.between(*SOFT_WORD)
    )


def host_verdicts(flags: DataFrame, z: float = HOST_Z) -> DataFrame:
    """(host, n, failed, host_rate, host_bad) from rows (host, soft).

    Failures are summed per host before anything meets. The beta prior has the mean and variance of the hosts' own rates (moments; with
    one host or equal rates it is the uniform prior), so a host of few documents stays near the common rate. A host is bad when its shrunk
    rate less ``z`` standard deviations of its beta posterior is over the prior's mean: hosts are measured against each other, not
    against a fixed share, and one bad document of a small host does not decide.
    """
    hosts = flags.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("soft").cast("int")).alias("failed"))
    rates = hosts.agg(F.avg(F.col("failed") / F.col("n")).alias("m"), F.var_pop(F.col("failed") / F.col("n")).alias("v"))
    strength = F.col("m") * (1 - F.col("m")) / F.col("v") - 1
    known = (F.col("v") > 1e-12) & (strength > 0)
    prior = rates.select(
        F.coalesce(F.when(known, F.col("m") * strength), F.lit(1.0)).alias("alpha"),
        F.coalesce(F.when(known, (1 - F.col("m")) * strength), F.lit(1.0)).alias("beta"),
    )
    one = prior.withColumn("one", F.lit(1))
    weight = F.col("n") + F.col("alpha") + F.col("beta")
    shrunk = (F.col("failed") + F.col("alpha")) / weight
    lowest = shrunk - z * F.sqrt(shrunk * (1 - shrunk) / (weight + 1))
    return (
        hosts.withColumn("one", F.lit(1)).join(one, "one")
        .select("host", "n", "failed", shrunk.alias("host_rate"), (lowest > F.col("alpha") / (F.col("alpha") + F.col("beta"))).alias("host_bad"))
    )


def with_verdicts(rows: DataFrame, host: str, z: float = HOST_Z) -> DataFrame:
    """rows (host column and the counts) with base_failed, host_rate and kept."""
    rows = rows.withColumn("base_failed", base_failed()).withColumn("_soft", soft_failed())
    hosts = host_verdicts(rows.select(F.col(host).alias("host"), F.col("_soft").alias("soft")), z)
    hosts = cut_lineage(hosts.select(F.col("host").alias("_host"), "host_rate", "host_bad"))
    kept = ~F.col("base_failed") & ~(F.col("host_bad") & F.col("_soft"))
    return rows.join(hosts, F.col(host).eqNullSafe(F.col("_host"))).withColumn("kept", kept).drop("_host", "_soft", "host_bad")


def quality_rules(docs: DataFrame, host: str = "source", z: float = HOST_Z) -> DataFrame:
    """One row per document: ``row`` (the input row whole), the counts, base_failed, host_rate and kept.

    A null host is a host of its own. Repeated rows are judged alike, one row each. An empty table gives an empty table.
    """
    rows = counted(docs).withColumn("_key", F.col(f"_row.{host}"))
    return with_verdicts(rows, "_key", z).withColumnRenamed("_row", "row").drop("_key")


ORACLE = r"""
WITH worded AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
counted AS (SELECT doc_id, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, w FROM worded),
places AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM counted WHERE len(w) >= 3),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, [w[i], w[i + 1], w[i + 2]]) AS times FROM places),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM windows CROSS JOIN range(3) t(k) WHERE times > 1 GROUP BY doc_id),
rows AS (SELECT doc_id, source, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  coalesce(n, 0)::BIGINT AS n_repeat_words FROM counted LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  100 * n_repeat_words > 30 * n_words OR 100 * n_symbols > 10 * n_words OR n_dup_lines >= 3
  OR NOT (word_chars / greatest(n_words, 1) BETWEEN 2.0 AND 15.0) AS soft FROM rows),
hosts AS (SELECT source, count(*) AS n, sum(soft::INT) AS failed FROM judged GROUP BY source),
moments AS (SELECT avg(failed / n) AS m, var_pop(failed / n) AS v FROM hosts),
prior AS (SELECT CASE WHEN v > 1e-12 AND m * (1 - m) / v - 1 > 0 THEN m * (m * (1 - m) / v - 1) ELSE 1.0 END AS alpha,
  CASE WHEN v > 1e-12 AND m * (1 - m) / v - 1 > 0 THEN (1 - m) * (m * (1 - m) / v - 1) ELSE 1.0 END AS beta FROM moments),
posterior AS (SELECT *, (failed + alpha) / (n + alpha + beta) AS rate FROM hosts CROSS JOIN prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (rate - 1.28 * sqrt(rate * (1 - rate) / (n + alpha + beta + 1)) > alpha / (alpha + beta) AND soft) AS kept
FROM judged j JOIN posterior h ON j.source IS NOT DISTINCT FROM h.source
"""


@query("op4_quality", ORACLE)
def op4(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text", "source")
    rows = counted(docs).select("_row.doc_id", "_row.source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return with_verdicts(cut_lineage(rows), "source").drop("source", "host_rate")
