r"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers.

Two first-order chains over the characters of tokens are trained from labelled samples: values that the fixed patterns find (random) and
words of ordinary text (identifiers). A long token is a secret where the log-likelihood ratio of the two chains, summed over its
character pairs, passes a threshold. Only DataFrame functions are used; the model is a bounded table (alphabet squared) that becomes one
literal array.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F

from carrierlake.session import cut_lineage

from .common import documents, hashed_sample, query, text_of

#: Base patterns in the order of their kinds, the group that holds the value, and its least length.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
MARKOV = "markov"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
#: Labelled rows that train the chains: so many documents of each label, those of the smallest text hash.
SAMPLE = 4000
#: Nats by which a token must be likelier under the random chain.
THRESHOLD = 12.0
SPAN = "array<struct<start:bigint,kind:int,end:bigint,value:string>>"


def spans_of(docs: DataFrame, name: str, text: str, kind: int, pattern: str, group: int, least: int) -> DataFrame:
    """docs with column ``name``: spans of one pattern, leftmost and non-overlapping, in code points, end exclusive."""
    here, regex = F.col(text).rlike(pattern), F.lit(pattern)
    found = F.regexp_extract_all(F.col(text), regex, F.lit(0))
    value = F.regexp_extract_all(F.col(text), regex, F.lit(group))
    staged = docs.withColumn("_found", F.when(here, F.arrays_zip(found.alias("all"), value.alias("value"))))
    staged = staged.withColumn("_between", F.when(F.col("_found").isNotNull(), F.split(F.col(text), pattern, -1)))
    none = F.array().cast(SPAN)

    def place(state, pair):
        start = state["at"] + F.length(pair["between"])
        end = start + F.length(pair["found"]["all"])
        span = F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), pair["found"]["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    pairs = F.zip_with("_found", F.slice("_between", 1, F.size("_found")), lambda f, b: F.struct(f.alias("found"), b.alias("between")))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))
    placed = F.filter(F.aggregate(pairs, start, place, lambda state: state["out"]), lambda s: F.length(s["value"]) >= least)
    return staged.withColumn(name, F.coalesce(placed, none)).drop("_found", "_between")


def candidate_spans(docs: DataFrame) -> DataFrame:
    """``row`` (the input row whole), ``base`` spans and ``tokens``: long tokens that lie inside no base span (they may reach into one)."""
    stage = docs.select(F.struct(*docs.columns).alias("row"), text_of().alias("_text"))
    for k, (name, pattern, group, least) in enumerate(KINDS):
        stage = spans_of(stage, f"_{name}", "_text", k, pattern, group, least)
    stage = spans_of(stage, "_tokens", "_text", len(KINDS), TOKEN, 0, 20)
    stage = stage.withColumn("base", F.sort_array(F.concat(*[f"_{k[0]}" for k in KINDS])))
    outside = lambda t: ~F.exists("base", lambda b: (b["start"] <= t["start"]) & (t["end"] <= b["end"]))
    return stage.select("row", "base", F.when(F.size("base") == 0, F.col("_tokens")).otherwise(F.filter("_tokens", outside)).alias("tokens"))


def place_in_alphabet(character: Column) -> Column:
    return F.instr(F.lit(ALPHABET), character) - 1


def labelled_samples(docs: DataFrame, spans: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(token, random): values of base spans, and words of six or more characters with the base patterns taken out."""
    values = hashed_sample(spans.where(F.size("base") > 0).select("base"), sample)
    values = values.select(F.explode(F.transform("base", lambda b: b["value"])).alias("token"), F.lit(1).alias("random"))
    text = F.col("text")
    for _, pattern, _, _ in KINDS:
        text = F.regexp_replace(text, pattern, " ")
    plain = hashed_sample(docs.where(F.length("text") > 0).select("text"), sample)
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/_=-]{6,}"), F.lit(0))
    return values.unionByName(plain.select(F.explode(words).alias("token"), F.lit(0).alias("random")))


def train_ratio(samples: DataFrame) -> list[float]:
    """Log-likelihood ratio of every ordered character pair; one pseudo-count per pair, so an empty sample gives zeros."""
    n = len(ALPHABET)
    pairs = F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2)))
    seen = samples.where(F.length("token") > 1).select("random", F.explode(pairs).alias("pair")).groupBy("pair").agg(
        F.sum("random").alias("r"), F.sum(1 - F.col("random")).alias("o")
    )
    first, second = place_in_alphabet(F.substring("pair", 1, 1)), place_in_alphabet(F.substring("pair", 2, 1))
    seen = seen.where((first >= 0) & (second >= 0)).select((first * n + second).cast("bigint").alias("id"), "r", "o")
    grid = samples.sparkSession.range(n * n).join(seen, "id", "left")
    of = Window.partitionBy(F.floor(F.col("id") / n))
    chain = lambda c: F.log((F.coalesce(c, F.lit(0)) + 1) / (F.sum(F.coalesce(c, F.lit(0)) + 1).over(of)))
    table = grid.select("id", (chain(F.col("r")) - chain(F.col("o"))).alias("ratio"))
    ordered = F.sort_array(F.collect_list(F.struct("id", "ratio")))  # alphabet squared rows, whatever the corpus
    return list(table.agg(F.transform(ordered, lambda x: x["ratio"]).alias("ratios")).first().ratios)


def likelihood_ratio(token: Column, ratios: list[float]) -> Column:
    """Sum over character pairs; a character outside the alphabet adds nothing."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    at = lambda i: place_in_alphabet(F.substring(token, i, F.lit(1)))
    step = lambda total, i: total + F.coalesce(F.get(table, at(i) * len(ALPHABET) + at(i + 1)), F.lit(0.0))
    return F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), step)


def with_markov(spans: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """spans with ``spans``: base and the tokens that the chains call random, by start, then kind."""
    random = F.filter("tokens", lambda t: likelihood_ratio(t["value"], ratios) >= threshold)
    return spans.withColumn("spans", F.sort_array(F.concat(F.col("base"), random))).drop("tokens")


def scan_secrets(docs: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``row`` (the input row whole), ``base`` and ``spans`` as (start, kind, end, value).

    Null or empty text has no spans. Repeated rows give repeated results. Without any base span the random chain is uniform.
    """
    narrow = cut_lineage(candidate_spans(docs.select("text")).select("base"))
    ratios = train_ratio(labelled_samples(docs, narrow, sample))
    return with_markov(candidate_spans(docs), ratios, threshold)


def redacted(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every span (overlapping ones merged) replaced by the mask."""

    def step(state, s):
        before = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        joins = (s["start"] < state["at"]) & (state["at"] > 0)
        out = F.when(joins, state["out"]).otherwise(F.concat(state["out"], before, F.lit(mask)))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    rest = lambda state: F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def joined_spans(spans: str) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit(MARKOV))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


@query("op3_secrets")
def op3(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    spans = cut_lineage(candidate_spans(docs).select("row.doc_id", "base", "tokens"))
    found = with_markov(spans, train_ratio(labelled_samples(docs, spans)))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)],
        F.sha2(joined_spans("base"), 256).alias("base_sha256"),
        joined_spans("spans").alias("spans"),
    )
