"""Parsers run on text lines spelled from the driver tables."""

from pyspark.sql import functions as F

from carrierlake.sources import tables, text
from carrierlake.plans.registry import query, rounded


@query(
    "parse_panel",
    """SELECT DISTINCT 'chr' || p_size AS chr, p_partkey AS start, p_partkey + 200 AS "end", CASE WHEN p_partkey % 3 > 0 THEN 'amp' || p_partkey END AS amplicon_id,
      CASE WHEN p_partkey % 3 = 2 THEN 'rs' || p_partkey END AS rsid, CASE WHEN p_partkey % 3 = 2 THEN p_type END AS gene, p_partkey + 1 AS start_1based FROM part WHERE p_partkey % 50 <> 0""",
)
def _panel(t):
    k = F.col("p_partkey")
    chrom = F.when(k % 2 == 0, F.concat(F.lit("chr"), "p_size")).otherwise(F.col("p_size").cast("string"))
    rest = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.concat(F.lit("\tamp"), k)).otherwise(F.concat(F.lit("\tamp"), k, F.lit("\trs"), k, F.lit("\t"), "p_type"))
    line = F.when(k % 100 == 0, "track name=x").when(k % 50 == 0, "chrom start end").otherwise(F.concat(chrom, F.lit("\t"), k, F.lit("\t"), k + 200, rest, F.lit("\r")))
    return text.parse_panel(t.part.select(line.alias("value")))


@query(
    "parse_panel_wide",
    """SELECT DISTINCT 'chr' || p_size AS chr, p_partkey AS start, p_partkey + 200 AS "end", 'amp' || p_partkey AS amplicon_id, 'rs' || p_partkey AS rsid, 'G' || p_size AS gene,
      p_partkey + 1 AS start_1based, CASE WHEN p_partkey % 3 > 0 THEN p_brand END AS pool, CASE WHEN p_partkey % 3 = 2 THEN 's' || p_size END AS extra_2 FROM part WHERE p_partkey % 50 <> 0""",
)
def _panel_wide(t):
    """A header that names seven of eight columns; lines of six to eight fields."""
    k, tab = F.col("p_partkey"), F.lit("\t")
    six = F.concat_ws("\t", "p_size", k, k + 200, F.concat(F.lit("amp"), k), F.concat(F.lit("rs"), k), F.concat(F.lit("G"), "p_size"))
    rest = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.concat(tab, "p_brand")).otherwise(F.concat(tab, "p_brand", tab, F.lit("s"), "p_size"))
    header = "Chrom\tStart\tEnd\tAmplicon_ID\trsID\tGene\tPool"
    lines = t.part.select(F.when(k % 100 == 0, "browser position").when(k % 50 == 0, header).otherwise(F.concat(six, rest)).alias("value"))
    return text.parse_panel(lines, extras=text.panel_layout(lines)[len(text.PANEL_COLUMNS):])


@query(
    "parse_depth",
    """SELECT l_suppkey::VARCHAR AS sample, 'chr' || l_linenumber AS chr, l_orderkey AS start, l_orderkey + 10 AS "end", l_quantity AS depth FROM lineitem""",
)
def _depth(t):
    raw = t.lineitem.select(
        F.col("l_linenumber").cast("string").alias("f0"), F.col("l_orderkey").cast("string").alias("f1"), (F.col("l_orderkey") + 10).cast("string").alias("f2"),
        F.col("l_returnflag").alias("f3"), F.col("l_quantity").cast("string").alias("f4"), F.col("l_suppkey").cast("string").alias("name"),
    )
    return text.parse_depth(raw, ["f0", "f1", "f2", "f3", "f4"], F.col("name"))


def call_lines(t):
    k = F.col("l_orderkey")
    alts = F.when(F.col("l_linenumber") % 2 == 0, "A,T").otherwise("G")
    csq = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit(";CSQ=A|"), "l_returnflag", F.lit("|x1,T|"), "l_linestatus", F.lit("|,A|second|x3"))).otherwise("")
    info = F.concat(F.lit("DP="), F.col("l_quantity").cast("int") * 2, csq)
    form = F.when(F.col("l_linenumber") % 2 == 0, "GT:AO:RO").otherwise("GT:AF")
    value = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("1/2:"), F.col("l_quantity").cast("int"), F.lit(",6:10"))).otherwise(F.concat(F.lit("0/1:"), "l_discount"))
    line = F.concat_ws("\t", F.col("l_suppkey"), k, F.lit("."), F.lit("C"), alts, F.lit("30"), F.when(F.col("l_returnflag") == "R", "LOW").otherwise("PASS"), info, form, value)
    return t.lineitem.select(line.alias("value"))


CALLS = """cx AS (SELECT 'chr' || l_suppkey AS CHROM, l_orderkey AS POS, 'C' AS REF, 30.0::DOUBLE AS QUAL, CASE WHEN l_returnflag = 'R' THEN 'LOW' ELSE 'PASS' END AS FILTER, (l_quantity::INT * 2)::INT AS DP, * FROM lineitem),
  vc AS (SELECT CHROM, POS, REF, 'G' AS ALT, QUAL, FILTER, DP, l_discount AS AF, '0/1' AS GT, NULL AS Consequence, NULL AS Feature, NULL AS Allele FROM cx WHERE l_linenumber % 2 = 1
    UNION ALL SELECT CHROM, POS, REF, 'A', QUAL, FILTER, DP, l_quantity / (l_quantity + 10), '1/2', l_returnflag, 'x1', 'A' FROM cx WHERE l_linenumber % 2 = 0
    UNION ALL SELECT CHROM, POS, REF, 'A', QUAL, FILTER, DP, l_quantity / (l_quantity + 10), '1/2', 'second', 'x3', 'A' FROM cx WHERE l_linenumber % 2 = 0
    UNION ALL SELECT CHROM, POS, REF, 'T', QUAL, FILTER, DP, 6 / 16.0::DOUBLE, '1/2', l_linestatus, NULL, 'T' FROM cx WHERE l_linenumber % 2 = 0)"""
COLUMNS = 'CHROM, POS, REF, ALT, QUAL, FILTER, DP, round(AF, 6) AS AF, GT, Allele, Consequence, Feature'


@query("parse_calls", f"WITH {CALLS} SELECT {COLUMNS} FROM vc")
def _calls(t):
    return rounded(text.parse_calls(call_lines(t), ["Allele", "Consequence", "Feature"]))


INDELS = """ix AS (SELECT 'chr' || l_suppkey AS CHROM, l_orderkey AS POS, l_linenumber % 2 = 0 AS del, * FROM lineitem)
  SELECT CHROM, POS, l_linenumber, 'CA' AS REF, 'C' AS ALT, '-' AS Allele, 'frameshift' AS Consequence, 'x' || l_suppkey AS Feature FROM ix WHERE del
  UNION ALL SELECT CHROM, POS, l_linenumber, 'C', a, b, c, f FROM ix, (VALUES ('CT', 'T', 'insertion', 'x1'), ('CT', 'CT', 'whole', NULL), ('G', 'G', 'missense', 'x3'), ('CT', 'Z', 'odd', 'x9')) v(a, b, c, f) WHERE NOT del"""


@query("parse_calls_indels", f"WITH {INDELS}")
def _indels(t):
    """Deletions and insertions by trimmed allele, an entry of no allele, and two field orders."""
    deletion, swapped = F.col("l_linenumber") % 2 == 0, F.col("l_suppkey") % 2 == 0
    entry = lambda allele, what, feature: F.when(swapped, F.concat_ws("|", F.lit(allele), feature, F.lit(what))).otherwise(F.concat_ws("|", F.lit(allele), F.lit(what), feature))
    known = F.concat(F.lit("x"), F.col("l_suppkey").cast("string"))
    csq = F.when(deletion, entry("-", "frameshift", known)).otherwise(
        F.concat_ws(",", entry("T", "insertion", F.lit("x1")), entry("CT", "whole", F.lit("")), entry("G", "missense", F.lit("x3")), entry("Z", "odd", F.lit("x9")))
    )
    line = F.concat_ws("\t", "l_suppkey", "l_orderkey", F.lit("."), F.when(deletion, "CA").otherwise("C"), F.when(deletion, "C").otherwise("CT,G"), F.lit("30"), F.lit("PASS"), F.concat(F.lit("CSQ="), csq))
    orders = [F.array(*[F.lit(x) for x in names]) for names in (("Allele", "Feature", "Consequence"), ("Allele", "Consequence", "Feature"))]
    lines = t.lineitem.select(line.alias("value"), "l_linenumber", F.when(swapped, orders[0]).otherwise(orders[1]).alias("order"))
    out = text.parse_calls(lines, ["Allele", "Consequence", "Feature"], keep=["l_linenumber"], order="order")
    return out.select("CHROM", "POS", "l_linenumber", "REF", "ALT", "Allele", "Consequence", "Feature")


@query("passing_sites", f"WITH {CALLS} SELECT {COLUMNS} FROM vc WHERE DP >= 50 AND FILTER = 'PASS' AND length(ALT) = 1 AND CHROM = 'chr7'")
def _passing(t):
    calls = text.parse_calls(call_lines(t), ["Allele", "Consequence", "Feature"])
    return rounded(text.simple_snvs(text.passing_sites(calls), "chr7"))


@query(
    "matrix_to_long",
    "SELECT s_suppkey, s_name, 'a' AS sample, s_nationkey::VARCHAR AS gt FROM supplier UNION ALL SELECT s_suppkey, s_name, 'b', '0|1' FROM supplier",
)
def _matrix(t):
    wide = t.supplier.select("s_suppkey", "s_name", F.col("s_nationkey").cast("string").alias("a"), F.lit("0|1").alias("b"))
    return text.matrix_to_long(wide, ["s_suppkey", "s_name"])


@query(
    "normalise_panel",
    "SELECT c_name AS sample, c_mktsegment AS pop, NULL::VARCHAR AS super_pop, CASE c_custkey % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END AS sex FROM customer",
)
def _reference(t):
    k = F.col("c_custkey") % 3
    raw = t.customer.select(F.col("c_name").alias("Sample name"), F.col("c_mktsegment").alias("Population"), F.when(k == 0, "1").when(k == 1, " F").otherwise("?").alias("GENDER"))
    return text.normalise_panel(raw.unionByName(raw))


@query(
    "parse_manifest",
    "SELECT DISTINCT '/data/' || s_nationkey || '/S' || s_suppkey || '_pass.txt' AS path, 'S' || s_suppkey AS sample FROM supplier WHERE s_suppkey % 9 <> 0",
)
def _manifest(t):
    k = F.col("s_suppkey")
    line = F.when(k % 9 == 0, F.concat(F.lit("# "), k)).otherwise(F.concat(F.lit(" /data/"), "s_nationkey", F.lit("/S"), k, F.lit("_pass.txt\r")))
    lines = t.supplier.select(line.alias("value"))
    return tables.parse_manifest(lines.unionByName(lines), r"^(S\d+)_pass")


@query("duplicate_samples", "SELECT c_mktsegment AS sample, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 1")
def _duplicates(t):
    return tables.duplicate_samples(t.customer.select(F.col("c_mktsegment").alias("sample")))


@query(
    "path_context",
    "SELECT s_suppkey, 'nation' || s_nationkey AS cohort, CASE WHEN s_acctbal < 2000 THEN 'Tumour' ELSE 'Healthy' END AS tissue, 'S' || s_suppkey || '.vcf' AS file_name FROM supplier",
)
def _context(t):
    tissue = F.when(F.col("s_acctbal") < 2000, "Tumour").otherwise("Healthy")
    path = F.concat(F.lit("file:///x/nation"), "s_nationkey", F.lit("/"), tissue, F.lit("/S"), "s_suppkey", F.lit(".vcf"))
    df = t.supplier.select("s_suppkey", path.alias("path"))
    return tables.with_path_context(df, ["cohort", "tissue"], F.col("path")).drop("path")


@query("union_cohort_tables", "SELECT *, 'a' AS cohort FROM supplier UNION ALL SELECT *, 'b' FROM supplier")
def _cohorts(t):
    path = f"{t.folder}/supplier.parquet"
    return tables.union_cohort_tables(t.spark, {"a": path, "b": path})


@query("read_or_default", "SELECT s_suppkey, s_name FROM supplier")
def _default(t):
    fallback = t.supplier.select("s_suppkey", "s_name")
    return tables.read_or_default(t.spark, f"{t.folder}/absent.parquet", fallback.schema, fallback)
