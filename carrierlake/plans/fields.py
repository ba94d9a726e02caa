"""Scalar rules: keys, labels, genotype text, consequence terms, sequences."""

from pyspark.sql import functions as F

from carrierlake.functions import annotation, genotype, keys
from carrierlake.functions.sequence import sequence_metrics
from carrierlake.plans.registry import query, rounded
from carrierlake.sources import tables

# One call per order line, spelled the way call files spell it.
CALL_TEXT = """calltext AS (SELECT o_custkey AS sample, l_orderkey, p_brand AS chrom, p_size AS pos, p_partkey,
    substr('ACGT', (p_partkey % 4 + 1)::INT, 1) AS ref, substr('ACGT', (l_suppkey % 4 + 1)::INT, 1) AS alt,
    CASE WHEN l_linenumber = 7 THEN './.' WHEN l_linenumber = 6 THEN '1/2' WHEN l_returnflag = 'A' THEN '0/1'
      WHEN l_returnflag = 'N' THEN '0|0' ELSE '1/1' END AS gt,
    (l_quantity * 2)::INT AS dp, l_quantity::INT || ',' || l_linenumber || ',2' AS ad, l_discount * 10 AS af
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def call_text(t):
    flag = F.col("l_returnflag")
    gt = (
        F.when(F.col("l_linenumber") == 7, "./.").when(F.col("l_linenumber") == 6, "1/2")
        .when(flag == "A", "0/1").when(flag == "N", "0|0").otherwise("1/1")
    )
    base = lambda c: F.substring(F.lit("ACGT"), (F.col(c) % 4 + 1).cast("int"), F.lit(1))
    return t.purchases().select(
        "sample", "l_orderkey", F.col("p_brand").alias("chrom"), F.col("p_size").alias("pos"), "p_partkey",
        base("p_partkey").alias("ref"), base("l_suppkey").alias("alt"), gt.alias("gt"),
        (F.col("l_quantity") * 2).cast("int").alias("dp"),
        F.concat_ws(",", F.col("l_quantity").cast("int"), "l_linenumber", F.lit(2)).alias("ad"),
        (F.col("l_discount") * 10).alias("af"),
    )


RAW_CHROM = """CASE p_size % 7 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN 'chrx' WHEN 2 THEN ' MT' WHEN 3 THEN NULL
    WHEN 4 THEN 'CHR' || p_size WHEN 5 THEN 'y ' ELSE 'scaffold_' || p_size END"""


def raw_chrom():
    k = F.col("p_size") % 7
    text = F.col("p_size").cast("string")
    return (
        F.when(k == 0, text).when(k == 1, "chrx").when(k == 2, " MT").when(k == 3, F.lit(None).cast("string"))
        .when(k == 4, F.concat(F.lit("CHR"), text)).when(k == 5, "y ").otherwise(F.concat(F.lit("scaffold_"), text))
    )


NORM_SQL = """CASE WHEN raw IS NULL THEN '' ELSE CASE WHEN upper(regexp_replace(trim(raw), '^chr', '', 'i')) IN ('M', 'MT') THEN 'chrM'
    WHEN upper(regexp_replace(trim(raw), '^chr', '', 'i')) IN ('X', 'Y') THEN 'chr' || upper(regexp_replace(trim(raw), '^chr', '', 'i'))
    ELSE 'chr' || regexp_replace(trim(raw), '^chr', '', 'i') END END"""


@query(
    "norm_chrom",
    f"""WITH n AS (SELECT p_partkey, {RAW_CHROM} AS raw FROM part), m AS (SELECT p_partkey, {NORM_SQL} AS chrom FROM n)
    SELECT p_partkey, chrom, CASE WHEN regexp_full_match(substr(chrom, 4), '[0-9]+') THEN substr(chrom, 4)::INT WHEN chrom = 'chrX' THEN 1000001
      WHEN chrom = 'chrY' THEN 1000002 WHEN chrom = 'chrM' THEN 1000003 ELSE 1000004 END AS rank FROM m""",
)
def _norm(t):
    return t.part.select(
        "p_partkey", keys.norm_chrom(raw_chrom()).alias("chrom"), keys.chrom_rank(raw_chrom())["rank"].alias("rank")
    )


@query(
    "source_order",
    f"""WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS ordinal, {RAW_CHROM} AS raw FROM part), m AS (SELECT p_partkey, ordinal, {NORM_SQL} AS chrom FROM n)
    SELECT chrom, p_partkey, ordinal, row_number() OVER (PARTITION BY chrom ORDER BY ordinal) AS place FROM m""",
)
def _source_order(t):
    """Rows by chromosome, then as the file has them (the part table lies in key order)."""
    rows = tables.with_ordinal(t.part).select(keys.norm_chrom(raw_chrom()).alias("chrom"), "p_partkey", "ordinal")
    return tables.ordered_places(rows, "chrom").select("chrom", "p_partkey", "ordinal", "place").orderBy(keys.chrom_rank(F.col("chrom")), "ordinal")


@query(
    "map_labels",
    """SELECT event_id, CASE event_type WHEN 'signup' THEN 'Tumour' WHEN 'error' THEN 'Tumour' WHEN 'view' THEN 'Healthy'
      WHEN 'click' THEN 'Healthy' ELSE event_type END AS tissue FROM events""",
)
def _labels(t):
    raw = F.create_map(*[F.lit(x) for x in ("signup", "Tumor", "error", " Tumour ", "view", "Normal", "click", "Control")])
    text = F.coalesce(F.try_element_at(raw, F.col("event_type")), F.col("event_type"))
    return t.events.select("event_id", keys.map_labels(text).alias("tissue"))


@query(
    "coalesce_with_source",
    """SELECT doc_id, coalesce(CASE WHEN doc_id % 3 = 0 THEN NULL ELSE lang END, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE source END) AS value,
      CASE WHEN doc_id % 3 <> 0 THEN 'a' WHEN doc_id % 5 <> 0 THEN 'b' END AS value_source,
      coalesce(CASE WHEN quality = 1 THEN quality / 4.0 END, toxic / 8.0)::DOUBLE AS af,
      CASE WHEN quality = 1 THEN 'Exome_NFE' WHEN toxic IS NOT NULL THEN 'Genome_NFE' ELSE 'Missing' END AS af_source
      FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _coalesce(t):
    docs = t.documents.join(t.labels, "doc_id", "left").select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, "N/A").otherwise(F.col("lang")).alias("a"),
        F.when(F.col("doc_id") % 5 == 0, " ").otherwise(F.col("source")).alias("b"),
        F.when(F.col("quality") == 1, F.col("quality") / 4.0).alias("exome"), (F.col("toxic") / 8.0).alias("genome"),
    )
    value, source = keys.coalesce_with_source(["a", "b"])
    af, af_source = keys.combine_frequency(F.col("exome"), F.col("genome"))
    return docs.select("doc_id", value.alias("value"), source.alias("value_source"), af.alias("af"), af_source.alias("af_source"))


@query(
    "common_mask",
    """WITH x AS (SELECT l_returnflag, l_linestatus, coalesce(l_discount > 0.05, false) OR coalesce(CASE WHEN l_linenumber > 2 THEN l_tax END > 0.05, false) AS common,
      l_linenumber > 2 OR l_discount IS NOT NULL AS present FROM lineitem)
    SELECT l_returnflag, l_linestatus, count(*) FILTER (common) AS n_common, count(*) FILTER (NOT common) AS n_rare,
      count(*) FILTER (NOT common AND present) AS n_rare_known FROM x GROUP BY 1, 2""",
)
def _common(t):
    second = F.when(F.col("l_linenumber") > 2, F.col("l_tax"))
    common = keys.common_mask(0.05, F.col("l_discount"), second)
    known = keys.rare_mask(0.05, F.col("l_discount"), second, include_missing=False)
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(
        F.count_if(common).alias("n_common"), F.count_if(~common).alias("n_rare"), F.count_if(known).alias("n_rare_known")
    )


RS_TEXT = "text || ' RS' || doc_id || ' rs77 rs' || n_chars"


@query(
    "rsids",
    f"""WITH x AS (SELECT doc_id, {RS_TEXT} AS body FROM documents)
    SELECT doc_id, lower(nullif(regexp_extract(body, '(?i)(rs[0-9]+)', 1), '')) AS first_rsid,
      array_to_string(list_sort(list_distinct(regexp_extract_all(lower(body), 'rs[0-9]+'))), ',') AS all_rsids FROM x""",
)
def _rsids(t):
    body = F.concat(F.col("text"), F.lit(" RS"), F.col("doc_id"), F.lit(" rs77 rs"), F.col("n_chars"))
    return t.documents.select(
        "doc_id", keys.first_rsid(body).alias("first_rsid"), F.array_join(keys.all_rsids(body), ",").alias("all_rsids")
    )


@query(
    "variant_key",
    f"""WITH n AS (SELECT p_partkey, p_size, p_type, p_brand, p_name, {RAW_CHROM} AS raw FROM part),
      m AS (SELECT *, nullif({NORM_SQL}, '') AS chrom FROM n)
    SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'given' || p_partkey ELSE chrom || ':' || p_size || ':' || p_type || ':' || upper(p_name) END AS variant_key,
      chrom || ':' || p_size || ':' || p_type AS locus_key,
      CASE WHEN p_partkey % 4 = 0 THEN 'rs' || p_partkey WHEN p_partkey % 4 = 1 THEN p_brand || ':' || p_size ELSE 'key' || p_partkey END AS label,
      CASE WHEN chrom IS NULL THEN NULL ELSE chrom || ':' || p_size || '-' || (p_size + 20) END AS region FROM m""",
)
def _variant_key(t):
    k = F.col("p_partkey")
    existing = F.when(k % 10 == 0, F.concat(F.lit("given"), k)).otherwise("nan")
    chrom = raw_chrom()
    rsid = F.when(k % 4 == 0, F.concat(F.lit("rs"), k)).otherwise("-")
    gene = F.when(k % 4 == 1, F.col("p_brand")).otherwise("")
    return t.part.select(
        "p_partkey",
        keys.variant_key(chrom, F.col("p_size"), F.col("p_type"), F.col("p_name"), existing).alias("variant_key"),
        keys.locus_key(chrom, F.col("p_size"), F.col("p_type")).alias("locus_key"),
        keys.display_label(rsid, gene, F.col("p_size"), F.concat(F.lit("key"), k)).alias("label"),
        keys.interval_label(F.nullif(keys.norm_chrom(chrom), F.lit("")), F.col("p_size"), F.col("p_size") + 20).alias("region"),
    )


@query(
    "parse_gt",
    f"""WITH {CALL_TEXT}, x AS (SELECT *, gt IN ('0/1', '0|0', '1/1') AS ok FROM calltext)
    SELECT chrom, gt, CASE WHEN ok THEN substr(gt, 1, 1)::INT END AS a1, CASE WHEN ok THEN substr(gt, 3, 1)::INT END AS a2, ok AS callable,
      ok AND contains(gt, '|') AS phased, CASE gt WHEN '0|0' THEN 0 WHEN '0/1' THEN 1 WHEN '1/1' THEN 2 END AS dosage,
      CASE gt WHEN '0|0' THEN 0 WHEN '0/1' THEN 1 WHEN '1/1' THEN 2 WHEN '1/2' THEN 3 END AS loose_dosage, count(*) AS n FROM x
    GROUP BY ALL""",
)
def _parse(t):
    calls = call_text(t).select("chrom", "gt", genotype.parse_gt(F.col("gt")).alias("g"), genotype.parse_gt(F.col("gt"), strict=False)["dosage"].alias("loose_dosage"))
    flat = calls.select("chrom", "gt", "g.*", "loose_dosage")
    return flat.groupBy(*flat.columns).agg(F.count(F.lit(1)).alias("n"))


CLASS_SQL = """CASE WHEN gt = './.' OR dp <= 0 THEN 'No_call' WHEN gt = '0|0' THEN 'WT' WHEN gt = '0/1' THEN 'Het_ALT'
    WHEN gt = '1/1' THEN 'Hom_ALT' ELSE 'Other_ALT_model' END"""


@query(
    "classify_genotype",
    f"""WITH {CALL_TEXT}, x AS (SELECT *, {CLASS_SQL} AS raw_class FROM calltext)
    SELECT chrom, raw_class, CASE WHEN raw_class = 'No_call' THEN 'No_call' WHEN dp < 50 THEN 'Below_DP_threshold' ELSE raw_class END AS status, count(*) AS n
    FROM x GROUP BY 1, 2, 3""",
)
def _classify(t):
    raw = genotype.classify_genotype(F.col("gt"), F.col("dp"))
    return (
        call_text(t).select("chrom", raw.alias("raw_class"), genotype.threshold_status(raw, F.col("dp")).alias("status"))
        .groupBy("chrom", "raw_class", "status").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "allele_depths",
    f"""WITH {CALL_TEXT}, x AS (SELECT chrom, split_part(ad, ',', 1)::INT AS r, split_part(ad, ',', 2)::INT + 2 AS a, dp FROM calltext)
    SELECT chrom, sum(r)::BIGINT AS ref_depth, sum(a)::BIGINT AS alt_depth, round(avg(a / dp::DOUBLE), 6) AS mean_fraction,
      round(avg(a / (a + r)::DOUBLE), 6) AS mean_observed FROM x GROUP BY 1""",
)
def _depths(t):
    parsed = call_text(t).select("chrom", genotype.allele_depths(F.col("ad"), F.col("dp")).alias("d")).select("chrom", "d.*")
    return rounded(parsed.groupBy("chrom").agg(
        F.sum("ref_depth").alias("ref_depth"), F.sum("alt_depth").alias("alt_depth"), F.avg("alt_fraction").alias("mean_fraction"),
        F.avg(genotype.observed_fraction(F.col("alt_depth"), F.col("ref_depth"))).alias("mean_observed"),
    ))


TERMS = [name for name, _, _ in annotation.CONSEQUENCES] + ["made_up_term"]
TERM_TABLE = "terms AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{name}', '{tier}', '{label}')" for i, (name, tier, label) in enumerate([*annotation.CONSEQUENCES, ("made_up_term", "MODIFIER", "other")])
) + ") v(rank, term, tier, class))"


@query(
    "consequences",
    f"""WITH {TERM_TABLE}, x AS (SELECT p_partkey, a.term AS t1, a.rank AS r1, b.term AS t2, b.rank AS r2 FROM part
      JOIN terms a ON a.rank = p_size % 27 JOIN terms b ON b.rank = p_partkey % 27),
      w AS (SELECT p_partkey, t1 || '&' || t2 AS text, CASE WHEN r1 <= r2 THEN t1 ELSE t2 END AS worst FROM x)
    SELECT p_partkey, text, worst, class AS functional_class, tier AS impact FROM w JOIN terms ON term = worst""",
)
def _consequences(t):
    table = F.array(*[F.lit(x) for x in TERMS])
    text = F.concat_ws("&", F.get(table, F.col("p_size") % 27), F.get(table, (F.col("p_partkey") % 27).cast("int")))
    worst = annotation.worst_consequence(F.col("text"))
    return t.part.select("p_partkey", text.alias("text")).select(
        "p_partkey", "text", worst.alias("worst"), annotation.functional_class(worst).alias("functional_class"),
        annotation.infer_impact(worst).alias("impact"),
    )


@query(
    "predictors",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'deleterious' WHEN 1 THEN 'tolerated' WHEN 2 THEN 'deleterious' WHEN 3 THEN 'tolerated' ELSE '' END AS sift,
      CASE p_partkey % 5 WHEN 0 THEN 'probably_damaging' WHEN 1 THEN 'benign' WHEN 2 THEN 'probably_damaging' WHEN 3 THEN 'possibly_damaging' ELSE '' END AS polyphen FROM part""",
)
def _predictors(t):
    k = F.col("p_partkey") % 5
    pick = lambda *xs: F.get(F.array(*[F.lit(x) for x in xs]), k.cast("int"))
    sift = annotation.sift_class(pick("deleterious(0.02)", "Tolerated_low(0.3)", "-", ".", ""), pick("", "", "X;D;T", "T", "Q"))
    poly = annotation.polyphen_class(pick("probably_damaging(1)", "Benign(0)", "", ".", "na"), pick("", "", "D", "X,P,B", "Q"))
    return t.part.select("p_partkey", sift.alias("sift"), poly.alias("polyphen"))


@query(
    "neg_log10_p",
    "SELECT l_linenumber, l_discount, round(-log10(greatest(l_discount / 10, 1e-300)), 6) AS score, count(*) AS n FROM lineitem GROUP BY 1, 2, 3",
)
def _neglog(t):
    out = t.lineitem.select("l_linenumber", "l_discount", keys.neg_log10_p(F.col("l_discount") / 10).alias("score"))
    return rounded(out).groupBy("l_linenumber", "l_discount", "score").agg(F.count(F.lit(1)).alias("n"))


@query(
    "extract_code",
    """SELECT s_suppkey, 'SN' || lpad((CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE s_suppkey + 7 END)::VARCHAR, 4, '0') AS code FROM supplier""",
)
def _code(t):
    k = F.col("s_suppkey")
    raw = F.when(k % 2 == 0, F.concat(F.lit("run_SNP-"), k, F.lit("_x"))).otherwise(F.concat(F.lit("sample "), k + 7))
    return t.supplier.select("s_suppkey", keys.extract_code(raw, [(r"(?i)snp-?(\d+)", "SN%04d"), (r"sample (\d+)", "SN%04d")]).alias("code"))


STRETCH = "(SELECT coalesce(max(length(u)), 0) FROM unnest(string_split(array_to_string(list_transform(range(1, length(s) - {k} + 1), lambda i: CASE WHEN b[i] = b[i + {k}] THEN '1' ELSE '0' END), ''), '0')) q(u))"


@query(
    "sequence_metrics",
    f"""WITH x AS (SELECT doc_id, regexp_replace(upper(text), '[^ACGT]', '', 'g') AS s FROM documents),
      y AS (SELECT *, string_split(s, '') AS b, least(20, length(s)) AS w FROM x WHERE length(s) > 0),
      g AS (SELECT *, list_transform(range(1, length(s) - w + 2), lambda i: len(list_filter(b[i:i + w - 1], lambda z: z IN ('G', 'C'))) * 100.0 / w) AS win,
        length(s) - length(replace(s, 'G', '')) AS ng, length(s) - length(replace(s, 'C', '')) AS nc,
        {STRETCH.format(k=1)} AS m1, {STRETCH.format(k=2)} AS m2, {STRETCH.format(k=3)} AS m3 FROM y)
    SELECT doc_id, length(s)::INT AS n_bases, round((ng + nc) * 100.0 / length(s)::DOUBLE, 6) AS gc_pct,
      CASE WHEN ng + nc > 0 THEN round((ng - nc) / (ng + nc)::DOUBLE, 6) ELSE 0.0::DOUBLE END AS gc_skew,
      round(list_max(win)::DOUBLE, 6) AS max_window_gc, round(list_min(win)::DOUBLE, 6) AS min_window_gc, (m1 + 1)::INT AS max_homopolymer,
      greatest(CASE WHEN m2 >= 2 THEN (m2 + 2) // 2 * 2 ELSE 0 END, CASE WHEN m3 >= 3 THEN (m3 + 3) // 3 * 3 ELSE 0 END)::INT AS max_repeat,
      length(s) >= 12 AND len(list_filter(range(1, length(s) - 10), lambda i: contains(substr(s, i + 6), translate(reverse(substr(s, i, 6)), 'ACGT', 'TGCA')))) > 0 AS hairpin
    FROM g""",
)
def _sequence(t):
    seq = F.regexp_replace(F.upper("text"), "[^ACGT]", "")
    out = t.documents.select("doc_id", seq.alias("s")).where(F.length("s") > 0)
    return rounded(out.select("doc_id", F.length("s").alias("n_bases"), sequence_metrics(F.col("s")).alias("m")).select("doc_id", "n_bases", "m.*"))
