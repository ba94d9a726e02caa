"""Text layouts of the field: target panels, depth files, call files, wide matrices, population panels.

Every reader is ``parse_*`` on a DataFrame of lines or string columns plus a thin ``read_*`` that
supplies it, so parsing is plain Spark and can run on any source of lines.
"""

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from carrierlake.functions.keys import norm_chrom, null_if_token
from carrierlake.session import cut_lineage


#: Columns of a panel line in order, and the words of a header line.
PANEL_COLUMNS = ["chr", "start", "end", "amplicon_id", "rsid", "gene"]
HEADER_WORDS = ["CHR", "CHROM", "CHROMOSOME", "START", "END", "AMPLICONID", "AMPLICON", "RSID", "GENE", "NAME", "TARGET"]


def panel_fields(lines: DataFrame, column: str = "value") -> DataFrame:
    """One array ``_f`` per line that is no track, browser or comment line."""
    text = F.regexp_replace(F.col(column), "\r", "")
    fields = F.filter(F.split(F.trim(text), "[\t ]+"), lambda x: x != "")
    return lines.where(~F.lower(F.trim(text)).rlike("^(track|browser|#)")).select(fields.alias("_f"))


def panel_layout(lines: DataFrame, column: str = "value") -> list[str]:
    """Names of all columns of a panel, from one aggregate over its lines.

    A header line (two header words, or START and END in their places) names the columns after the sixth; those it does not name are
    ``extra_1`` and so on. Names are lower case, without other marks, and never equal to a fixed or an earlier one (``_2`` is added). Of
    several header lines the longest counts, then the largest.
    """
    words = F.transform("_f", lambda w: F.upper(F.regexp_replace(w, "[^A-Za-z0-9]", "")))
    header = (F.size(F.filter(words, lambda w: w.isin(HEADER_WORDS))) >= 2) | F.get(words, F.lit(1)).eqNullSafe("START") | F.get(words, F.lit(2)).eqNullSafe("END")
    seen = panel_fields(lines, column).agg(
        F.max(F.size("_f")).alias("width"), F.max_by(F.when(header, F.col("_f")), F.when(header, F.struct(F.size("_f"), F.col("_f")))).alias("header")
    ).first()
    names, taken = list(PANEL_COLUMNS), {*PANEL_COLUMNS, "start_1based"}
    given = seen.header or []
    for i in range(len(PANEL_COLUMNS), seen.width or 0):
        own = re.sub(r"[^a-z0-9]+", "_", given[i].lower()).strip("_") if i < len(given) else ""
        base = name = own or f"extra_{i - len(PANEL_COLUMNS) + 1}"
        copy = 1
        while name in taken:
            copy += 1
            name = f"{base}_{copy}"
        names.append(name)
        taken.add(name)
    return names


def parse_panel(lines: DataFrame, column: str = "value", extras: list[str] | None = None) -> DataFrame:
    """Target lines to (chr, start, end, amplicon_id, rsid, gene, start_1based) and one text column for each of ``extras``.

    Carriage returns go, track, browser, comment and header lines are skipped, three fields are
    required, repeats are dropped. ``extras`` names the fields from the seventh on (``panel_layout``); a short line has nulls there.
    """
    part = lambda i: F.get(F.col("_f"), F.lit(i))
    start, end = part(1).try_cast("bigint"), part(2).try_cast("bigint")
    rows = panel_fields(lines, column)
    return rows.where((F.size("_f") >= 3) & start.isNotNull() & end.isNotNull()).select(
        norm_chrom(part(0)).alias("chr"), start.alias("start"), end.alias("end"),
        null_if_token(part(3)).alias("amplicon_id"), null_if_token(part(4)).alias("rsid"), null_if_token(part(5)).alias("gene"),
        (start + 1).alias("start_1based"), *[null_if_token(part(len(PANEL_COLUMNS) + i)).alias(name) for i, name in enumerate(extras or [])],
    ).distinct()


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a panel file; its width and header are read first."""
    lines = spark.read.text(path)
    return parse_panel(lines, extras=panel_layout(lines)[len(PANEL_COLUMNS):])


def depth_column(df: DataFrame, fields: list[str]) -> str:
    """Which column holds the depth: the 4th of four; else the last one that is over 80 % numeric,
    else the most numeric one from 50 % on. The shares come from one aggregate pass."""
    if len(fields) == 4:
        return fields[3]
    candidates = fields[3:]
    shares = df.agg(*[F.avg(F.col(c).try_cast("double").isNotNull().cast("double")).alias(c) for c in candidates]).first().asDict()
    if (shares[candidates[-1]] or 0) > 0.8:
        return candidates[-1]
    best = max(candidates, key=lambda c: shares[c] or 0)
    if (shares[best] or 0) < 0.5:
        raise ValueError("no depth column: no field is at least half numeric")
    return best


def parse_depth(df: DataFrame, fields: list[str], sample: Column) -> DataFrame:
    """Delimited depth rows (strings) to (sample, chr, start, end, depth)."""
    depth = depth_column(df, fields)
    return df.select(
        sample.alias("sample"), norm_chrom(F.col(fields[0])).alias("chr"), F.col(fields[1]).try_cast("bigint").alias("start"),
        F.col(fields[2]).try_cast("bigint").alias("end"), F.col(depth).try_cast("double").alias("depth"),
    ).where(F.col("start").isNotNull() & F.col("end").isNotNull())


def read_depth(spark: SparkSession, path: str, n_fields: int = 4, pattern: str = r"([^/]+?)\.[^/]*$") -> DataFrame:
    """Many depth files at once; the sample is taken from the file name."""
    fields = [f"f{i}" for i in range(n_fields)]
    schema = ", ".join(f"{c} string" for c in fields)
    raw = spark.read.schema(schema).csv(path, sep="\t").select("*", F.col("_metadata.file_path").alias("_path"))
    return parse_depth(raw, fields, F.regexp_extract("_path", pattern, 1))


def _info(info: Column, key: str) -> Column:
    return F.nullif(F.regexp_extract(info, f"(?:^|;){key}=([^;]*)", 1), F.lit(""))


def trimmed_allele(ref: Column, alt: Column) -> Column:
    """The allele as annotators spell it: a shared first base of different lengths is cut, ``-`` where nothing is left."""
    cut = F.expr("substring(ALT, 2)")
    shared = (F.length(ref) != F.length(alt)) & (F.substring(ref, 1, 1) == F.substring(alt, 1, 1))
    return F.when(shared, F.when(F.length(cut) > 0, cut).otherwise("-")).otherwise(alt)


def parse_calls(lines: DataFrame, annotation_fields: list[str], column: str = "value", keep: list[str] = (), order: str | None = None) -> DataFrame:
    """Call lines to one row per alternate allele and annotation entry.

    Fields: chrom, pos, id, ref, alt, qual, filter, info, format, sample. Depth comes from DP, the
    allele fraction from AF, else from AO and RO. ``annotation_fields`` names the fields of the ``|``
    separated CSQ entry, in its order unless the array column ``order`` gives that of the line's file. An entry belongs to the allele
    it spells, whole or trimmed; one that spells none of them stays with the first. An allele without entry keeps one row.
    """
    part = F.split(F.replace(F.col(column), F.lit("\r"), F.lit("")), "\t")
    at = lambda i: F.get(F.col("_p"), F.lit(i))
    # an array of one, so that a later filter reads the split fields: pushed below a plain column it would split the line at every mention
    base = lines.where(~F.col(column).startswith("#")).select(
        *keep, F.explode(F.array(part)).alias("_p"), (F.col(order) if order else F.array(*[F.lit(x) for x in annotation_fields])).alias("_order")
    ).where(F.size("_p") >= 8)
    # every field once per line, before lines become alleles; the first of repeated keys counts
    sample = lambda key: F.get("_values", F.nullif(F.array_position("_names", key).cast("int"), F.lit(0)) - 1)
    staged = base.select(
        *keep, "_order", norm_chrom(at(0)).alias("CHROM"), at(1).try_cast("bigint").alias("POS"), at(3).alias("REF"), at(4).alias("_alts"),
        at(5).try_cast("double").alias("QUAL"), at(6).alias("FILTER"), at(7).alias("_info"),
        F.when(F.size("_p") >= 10, F.split(at(8), ":")).alias("_names"), F.split(at(9), ":").alias("_values"),
    )
    rows = staged.select(
        *keep, "_order", "CHROM", "POS", "REF", "_alts", "QUAL", "FILTER", _info(F.col("_info"), "CSQ").alias("_csq"), sample("GT").alias("_gt"),
        *[F.coalesce(sample(key), _info(F.col("_info"), key)).alias(f"_{key.lower()}") for key in ("DP", "AF", "AO", "RO")],
    ).select("*", F.posexplode(F.split("_alts", ",")).alias("_i", "ALT"))
    field = lambda key: F.col(f"_{key.lower()}")
    one = lambda key: F.get(F.split(field(key), ","), F.col("_i")).try_cast("double")
    ao, ro = one("AO"), field("RO").try_cast("double")
    spelled = lambda e: F.substring_index(e, "|", 1)
    trim = trimmed_allele(F.col("REF"), F.col("ALT"))
    every = F.expr(
        "flatten(transform(split(_alts, ','), x -> array(x, CASE WHEN length(REF) <> length(x) AND left(REF, 1) = left(x, 1) "
        "THEN CASE WHEN length(x) > 1 THEN substring(x, 2) ELSE '-' END ELSE x END)))"
    )
    rows = rows.withColumn("_trim", trim).withColumn("_every", every)
    own = lambda e: (spelled(e) == F.col("ALT")) | (spelled(e) == F.col("_trim")) | ((F.col("_i") == 0) & ~F.array_contains(F.col("_every"), spelled(e)))
    entries = F.filter(F.split("_csq", ","), own)
    parsed = rows.select(
        *keep, "_order", "CHROM", "POS", "REF", "ALT", "QUAL", "FILTER", field("DP").try_cast("int").alias("DP"),
        F.coalesce(one("AF"), F.try_divide(ao, ao + ro)).alias("AF"), F.col("_gt").alias("GT"), entries.alias("_e"),
    ).select("*", F.explode_outer("_e").alias("_entry")).drop("_e")
    entry = F.split("_entry", r"\|")
    place = lambda i, name: F.lit(i) if order is None else F.nullif(F.array_position("_order", name).cast("int"), F.lit(0)) - 1
    values = [null_if_token(F.get(entry, place(i, name)), [""]).alias(name) for i, name in enumerate(annotation_fields)]
    return parsed.select("*", *values).drop("_entry", "_order")


def annotation_orders(lines: DataFrame, column: str = "value", path: str = "path") -> DataFrame:
    """(path, order): field names of the CSQ entry from each file's own header line."""
    line = lines.where(F.col(column).startswith("##INFO=<ID=CSQ")).select(path, F.regexp_extract(column, 'Format: ([^"]+)"', 1).alias("_f"))
    return line.groupBy(path).agg(F.split(F.trim(F.min("_f")), r"\|").alias("order"))


def read_variant_calls(spark: SparkSession, path: str) -> DataFrame:
    """Calls of all files with the annotation fields of every header; a file's entries are read in its own order."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"))
    orders = cut_lineage(annotation_orders(lines))  # one row per file, written, so its true size decides how it is joined
    names = [r.name for r in orders.select(F.explode("order").alias("name")).distinct().orderBy("name").collect()]
    return parse_calls(lines.where(~F.col("value").startswith("#")).join(orders, "path", "left"), names, keep=["path"], order="order")


def passing_sites(calls: DataFrame, min_depth: int = 50, min_qual: float = 20.0) -> DataFrame:
    """Depth, quality and filter gate; plain comparisons, so they reach the Parquet scan."""
    return calls.where((F.col("DP") >= min_depth) & (F.col("QUAL") >= min_qual) & (F.col("FILTER") == "PASS"))


def simple_snvs(calls: DataFrame, chrom: str | None = None) -> DataFrame:
    """Single-base, biallelic sites, optionally of one chromosome."""
    one = (F.length("REF") == 1) & (F.length("ALT") == 1)
    return calls.where(one if chrom is None else one & (F.col("CHROM") == chrom))


def matrix_to_long(wide: DataFrame, id_columns: list[str], name: str = "sample", value: str = "gt") -> DataFrame:
    """Wide sample matrix (all strings) to long rows."""
    return wide.unpivot(id_columns, [c for c in wide.columns if c not in id_columns], name, value)


def read_matrix(spark: SparkSession, path: str, id_columns: list[str], sep: str = "\t") -> DataFrame:
    return matrix_to_long(spark.read.csv(path, sep=sep, header=True), id_columns)


# Accepted header spellings and sex codes of population panels.
PANEL_HEADERS = {
    "sample": ["sample", "sample_id", "sample name", "iid"],
    "pop": ["pop", "population", "population code"],
    "super_pop": ["super_pop", "superpopulation", "superpopulation code"],
    "sex": ["sex", "gender"],
}
SEX_CODES = {"1": "male", "2": "female", "m": "male", "f": "female", "male": "male", "female": "female"}


def normalise_panel(raw: DataFrame) -> DataFrame:
    """Population panel with any known header spelling to (sample, pop, super_pop, sex), one row per sample."""
    present = {c.strip().lower(): c for c in raw.columns}
    found = {k: next((present[n] for n in names if n in present), None) for k, names in PANEL_HEADERS.items()}
    if found["sample"] is None:
        raise ValueError("population panel without a sample column")
    codes = F.create_map(*[F.lit(x) for kv in SEX_CODES.items() for x in kv])
    text = lambda k: F.trim(F.col(f"`{found[k]}`")) if found[k] else F.lit(None).cast("string")
    shaped = raw.select(text("sample").alias("sample"), text("pop").alias("pop"), text("super_pop").alias("super_pop"), F.try_element_at(codes, F.lower(text("sex"))).alias("sex"))
    return shaped.where("sample <> ''").groupBy("sample").agg(*[F.min(c).alias(c) for c in ("pop", "super_pop", "sex")])


def read_reference_panel(spark: SparkSession, path: str) -> DataFrame:
    """Separator decided by the first line: tab, then comma, else blanks."""
    head = spark.read.text(path).first()[0]
    sep = "\t" if "\t" in head else "," if "," in head else " "
    return normalise_panel(spark.read.csv(path, sep=sep, header=True))
