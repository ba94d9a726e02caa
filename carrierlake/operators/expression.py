"""Expression tables in long form: normalisation, composition features, gates, profile tests."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from carrierlake.functions.draws import draw_matrix
from carrierlake.operators.ranking import known, quantiles
from carrierlake.operators.regression import _key_schema
from carrierlake.session import cut_lineage

PSEUDO = 1e-6
BANDS = 64
#: Rows of a key that a permutation kernel takes at once.
PERMUTED = 1024
#: Sums of squares that differ by less than this share of the total are equal.
TIE = 1e-9


def sum_present(*columns: Column) -> Column:
    """Null-aware sum: null only when every part is null."""
    total = F.lit(0.0)
    for c in columns:
        total = total + F.coalesce(c, F.lit(0.0))
    return F.when(F.coalesce(*columns).isNotNull(), total)


def log2_ratio(a: Column, b: Column) -> Column:
    return F.log2((a + PSEUDO) / (b + PSEUDO))


def composition_features(df: DataFrame, parts: list[str], numerator: list[str], name: str) -> DataFrame:
    """Fraction of the chosen parts in the total and their log2 balance against the rest."""
    top = sum_present(*[F.col(c) for c in numerator])
    rest = sum_present(*[F.col(c) for c in parts if c not in numerator])
    total = sum_present(*[F.col(c) for c in parts])
    return df.select(
        "*", total.alias(f"{name}_total"), F.when(total > 0, top / total).alias(f"{name}_fraction"), log2_ratio(top, rest).alias(f"{name}_log2")
    )


def normalise_expression(long: DataFrame, housekeeping: list[str]) -> DataFrame:
    """Counts per million and ratio to the geometric housekeeping mean.

    ``long``: sample, feature, value. The per-sample factors are one aggregate joined back.
    """
    house = F.when(F.col("feature").isin(housekeeping), F.log1p("value"))
    factors = long.groupBy("sample").agg(F.sum("value").alias("_size"), F.expm1(F.avg(house)).alias("_hk"))
    return long.join(factors, "sample").select(
        "sample", "feature", "value",
        F.when(F.col("_size") != 0, F.col("value") / F.col("_size") * 1e6).alias("cpm"),
        F.when(F.col("_hk") != 0, F.col("value") / F.col("_hk")).alias("ratio"),
    )


def expression_summary(long: DataFrame, keys: list[str]) -> DataFrame:
    """n, median, mean, sd and percentage of zeros per key."""
    stats = long.where(F.col("value").isNotNull()).groupBy(*keys).agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), (F.avg((F.col("value") == 0).cast("double")) * 100).alias("pct_zero")
    )
    return quantiles(long.select(*keys, "value"), keys, "value", {"median": 0.5}).join(stats, keys)


def composite_z(long: DataFrame, features: list[str], least: int = 2) -> DataFrame:
    """Mean of population z-scores over the signature features a sample has."""
    rows = long.where(F.col("feature").isin(features) & F.col("value").isNotNull())
    moments = rows.groupBy("feature").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s")).where("_s > 0")
    z = (F.col("value") - F.col("_m")) / F.col("_s")
    return rows.join(moments, "feature").groupBy("sample").agg(F.avg(z).alias("score"), F.count(F.lit(1)).alias("n_features")).where(F.col("n_features") >= least)


def usage_counts(rows: DataFrame, keys: list[str], sample: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(sample).alias("n_rows"), F.countDistinct(sample).alias("n_samples"))


# --- coverage gates -----------------------------------------------------------------------------


def panel_coverage(targets: DataFrame, low_depth: float = 20, reads_soft: int = 75, reads_strict: int = 100) -> DataFrame:
    """Covered, deep and well-read targets per sample. ``targets``: sample, mean_depth, reads (null = missing)."""
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return targets.groupBy("sample").agg(
        F.count(F.lit(1)).alias("n_targets"), F.count_if(F.col("mean_depth") > 0).alias("n_covered"),
        F.count("reads").alias("n_with_reads"), share(F.col("mean_depth") >= low_depth).alias("share_deep"),
        share(F.col("reads") >= reads_soft).alias("share_soft"), share(F.col("reads") >= reads_strict).alias("share_strict"),
        F.min("reads").alias("min_reads"), F.avg("mean_depth").alias("panel_mean_depth"),
    )


def coverage_risk(df: DataFrame, deep_soft: float = 0.5, deep_strict: float = 0.7, soft: float = 0.6, strict: float = 0.7) -> DataFrame:
    """Unavailable / High / Moderate / Low by the ordered rules of the gate."""
    level = (
        F.when(F.col("n_targets") <= 0, "Unavailable")
        .when((F.col("n_with_reads") <= 0) | (F.col("n_with_reads") < F.col("n_targets")), "High")
        .when(F.col("share_deep").isNull() | (F.col("share_deep") < deep_soft), "High")
        .when(F.col("share_soft").isNull() | (F.col("share_soft") < soft), "High")
        .when(F.col("share_strict").isNull() | (F.col("share_strict") < strict) | (F.col("share_deep") < deep_strict), "Moderate")
        .otherwise("Low")
    )
    return df.withColumn("risk_level", level)


def machine_flag(reads: Column, q20: Column) -> Column:
    return (
        F.when(reads.isNull() & q20.isNull(), "Unmatched")
        .when((reads < 10000) | (q20 < 85.0), "Hard_fail")
        .when((reads < 50000) | (q20 < 92.0), "Warning")
        .otherwise("Pass")
    )


def gate_decision(df: DataFrame) -> DataFrame:
    """Ordered decision per sample: status and exclusion reason.

    Columns: matched, baseline, file_present, index_present, complete, note, n_targets, n_with_reads, risk_level.
    """
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    note = F.lower(F.coalesce("note", F.lit("")))
    context, reads = "Missing/invalid design context", "Missing/invalid read-count context"
    rules = [
        (no("matched"), "Unmatched to master"), (no("baseline"), "No baseline file"), (no("file_present"), "Missing matched file"),
        (no("index_present"), "File/index failure"),
        (no("complete") & (note.contains("bed") | note.contains("target")), context),
        (no("complete") & (note.contains("index") | note.contains("samtools")), "File/index failure"),
        (no("complete"), "QC incomplete"),
        (F.col("n_targets").isNull() | (F.col("n_targets") <= 0), context),
        (F.col("n_with_reads").isNull() | (F.col("n_with_reads") < F.col("n_targets")), reads),
        (F.col("risk_level") == "Unavailable", context),
    ]
    reason = None
    for condition, text in rules:
        reason = F.when(condition, text) if reason is None else reason.when(condition, text)
    reason = reason.otherwise("")
    status = F.when(reason != "", "Excluded").when(F.col("risk_level").isin("High", "Moderate"), "Exploratory").otherwise("Analysis-ready")
    return df.withColumn("reason", reason).withColumn("final_status", status)


def manifest_summary(df: DataFrame, group: str) -> DataFrame:
    """Rows, passes and exploratory counts per group and Overall."""
    status = F.col("final_status")
    return (
        df.rollup(group)
        .agg(
            F.count(F.lit(1)).alias("total"), F.count_if(status == "Analysis-ready").alias("passed"),
            F.count_if(status == "Exploratory").alias("exploratory_only"), F.count_if(status == "Excluded").alias("excluded"), F.grouping(group).alias("_g"),
        )
        .withColumn(group, F.when(F.col("_g") == 1, "Overall").otherwise(F.col(group)))
        .withColumn("pass_pct", F.col("passed") * 100.0 / F.col("total"))
        .drop("_g")
    )


def exclusion_reasons(df: DataFrame, group: str) -> DataFrame:
    return df.where("reason <> ''").groupBy(group, "reason").agg(F.count(F.lit(1)).alias("n"))


# --- compositional test -----------------------------------------------------------------------------


def clr(df: DataFrame, parts: list[str]) -> DataFrame:
    """Centred log-ratios ``c0..`` of non-negative parts with a positive sum."""
    total = sum((F.col(c) for c in parts[1:]), F.col(parts[0]))
    valid = df.dropna(subset=parts).where(total > 0)
    for c in parts:
        valid = valid.where(F.col(c) >= 0)
    logs = [F.ln(F.col(c) / total + PSEUDO) for c in parts]
    valid = valid.select("*", *[e.alias(f"_l{i}") for i, e in enumerate(logs)])
    mean = sum((F.col(f"_l{i}") for i in range(1, len(parts))), F.col("_l0")) / len(parts)
    return valid.select(*df.columns, *[(F.col(f"_l{i}") - mean).alias(f"c{i}") for i in range(len(parts))])


def _between(sums: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Between-group sum of squares, n and group count per key from rows (keys, group, _ng, _s0..)."""
    square = lambda p: sum((F.col(f"{p}{i}") * F.col(f"{p}{i}") for i in range(1, k)), F.col(f"{p}0") * F.col(f"{p}0"))
    folded = sums.groupBy(*keys).agg(
        F.sum(square("_s") / F.col("_ng")).alias("_g"), F.sum("_ng").alias("n"), F.count(F.lit(1)).alias("n_groups"),
        *[F.sum(f"_s{i}").alias(f"_t{i}") for i in range(k)],
    )
    return folded.select(*keys, "n", "n_groups", F.greatest(F.col("_g") - square("_t") / F.col("n"), F.lit(0.0)).alias("between_ss"))


def _group_sums(rows: DataFrame, keys: list[str], k: int) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_ng"), *[F.sum(f"c{i}").alias(f"_s{i}") for i in range(k)])


def clr_permanova(df: DataFrame, keys: list[str], row_id: str, group: str, parts: list[str], permutations: int = 499, seed: int = 42) -> DataFrame:
    """Pseudo-F of log-ratio profiles between groups per key, p = (hits + 1) / (permutations + 1).

    The total sum of squares does not change under permutation, so only group sums are redone.
    A permutation orders the rows by a hashed draw and hands out the group sizes in that order. Rows lie in
    blocks; a kernel draws for all rows of a block and all permutations at once and returns sums per band of
    draws. A band inside one group is only summed, and just the rows of the few bands a group boundary
    falls into leave their block to be ranked.
    """
    k = len(parts)
    rows = cut_lineage(clr(df.select(*keys, row_id, group, *parts), parts).drop(*parts))
    squares = sum((F.col(f"c{i}") * F.col(f"c{i}") for i in range(1, k)), F.col("c0") * F.col("c0"))
    centre = sum((F.col(f"_t{i}") * F.col(f"_t{i}") for i in range(1, k)), F.col("_t0") * F.col("_t0"))
    total = rows.groupBy(*keys).agg(
        F.sum(squares).alias("_q"), F.count(F.lit(1)).alias("_n"), *[F.sum(f"c{i}").alias(f"_t{i}") for i in range(k)]
    ).select(*keys, "_n", (F.col("_q") - centre / F.col("_n")).alias("total_ss"))
    per_group = _group_sums(rows, [*keys, group], k)
    observed = _between(per_group, keys, k).join(total.drop("_n"), keys)
    # Ranks up to ``upto`` go to group ``g``; a key has a handful of groups.
    order = Window.partitionBy(*keys).orderBy(group).rowsBetween(Window.unboundedPreceding, 0)
    cuts = per_group.select(*keys, group, F.sum("_ng").over(order).alias("upto")).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("upto", F.col(group).alias("g")))).alias("_cuts")
    )
    label = lambda place: F.get(F.filter("_cuts", lambda s: place <= s["upto"]), F.lit(0))["g"]
    by = [*keys, "perm"]
    item = F.struct(F.col(row_id).cast("bigint").alias("id"), *[f"c{i}" for i in range(k)])
    numbered = rows.join(total.select(*keys, "_n"), keys).withColumn("_block", F.pmod(F.xxhash64(row_id), F.ceil(F.col("_n") / PERMUTED)))
    blocks = cut_lineage(numbered.groupBy(*keys, "_block").agg(F.collect_list(item).alias("_rows")).drop("_block"))
    summed = blocks.mapInArrow(_band_sums(keys, k, permutations, seed), _key_schema(blocks, keys) + ", perm int, _band int, _ng bigint, " + ", ".join(f"_s{i} double" for i in range(k)))
    sums = ["_ng", *[f"_s{i}" for i in range(k)]]
    along = Window.partitionBy(*by).orderBy("_band").rowsBetween(Window.unboundedPreceding, 0)
    bands = cut_lineage(
        summed.groupBy(*by, "_band").agg(*[F.sum(c).alias(c) for c in sums]).withColumn("_upto", F.sum("_ng").over(along)).join(cuts, keys)
        .withColumn("_first", label(F.col("_upto") - F.col("_ng") + 1)).withColumn("_last", label(F.col("_upto")))
    )
    inside = bands.where("_first = _last").select(*by, F.col("_first").alias(group), *sums)
    split = bands.where("_first <> _last").select(*by, "_band", (F.col("_upto") - F.col("_ng")).alias("_before"), "_cuts")
    # permutations x groups entries per key at most
    wanted = split.groupBy(*keys).agg(F.collect_list(F.struct("perm", "_band")).alias("_wanted"))
    leaving = blocks.join(wanted, keys).mapInArrow(
        _rows_of_bands(keys, k, permutations, seed), _key_schema(blocks, keys) + ", perm int, _band int, _u double, id bigint, " + ", ".join(f"c{i} double" for i in range(k))
    )
    place = F.col("_before") + F.row_number().over(Window.partitionBy(*by, "_band").orderBy("_u", "id"))
    ranked = leaving.join(split, [*by, "_band"]).withColumn("_place", place).withColumn(group, label(F.col("_place")))
    parts_of = inside.unionByName(_group_sums(ranked, [*by, group], k)).groupBy(*by, group).agg(*[F.sum(c).alias(c) for c in sums])
    hits = (
        _between(parts_of, by, k).select(*keys, F.col("between_ss").alias("_b"))
        .join(observed.select(*keys, F.col("between_ss").alias("_o"), F.col("total_ss").alias("_all")), keys)
        .groupBy(*keys).agg(F.count_if(F.col("_b") >= F.col("_o") - TIE * F.col("_all")).alias("hits"))
    )
    within = F.col("total_ss") - F.col("between_ss")
    pseudo = (F.col("between_ss") / (F.col("n_groups") - 1)) / (within / (F.col("n") - F.col("n_groups")))
    return observed.where((F.col("n_groups") >= 2) & (F.col("n") > F.col("n_groups"))).join(hits, keys).select(
        *keys, "n", "n_groups", "between_ss", within.alias("within_ss"), "total_ss", F.when(within > 0, pseudo).alias("pseudo_f"),
        ((F.col("hits") + 1) / F.lit(permutations + 1.0)).alias("p_value"),
    )


def _block_draws(batch: pa.RecordBatch, i: int, k: int, permutations: int, seed: int):
    """(ids, profiles, draws of every permutation as rows) of one block."""
    found = batch.column("_rows")[i].values
    ids = found.field("id").to_numpy()
    profiles = np.stack([found.field(f"c{j}").to_numpy() for j in range(k)], axis=1)
    return ids, profiles, draw_matrix([np.arange(1, permutations + 1)[:, None], ids[None, :]], seed)


def _band_sums(keys: list[str], k: int, permutations: int, seed: int):
    """Kernel: rows and profile sums of a block per (permutation, band)."""
    shift = np.uint64(32 - (BANDS - 1).bit_length())

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, profiles, draws = _block_draws(batch, i, k, permutations, seed)
                at = ((draws >> shift).astype(np.int64) + np.arange(permutations)[:, None] * BANDS).ravel()
                size = permutations * BANDS
                count = np.bincount(at, minlength=size)
                held = np.flatnonzero(count)
                totals = [np.bincount(at, np.tile(profiles[:, j], permutations), size)[held] for j in range(k)]
                own = [batch.column(c).take(pa.array(np.full(len(held), i))) for c in keys]
                columns = [*own, pa.array((held // BANDS + 1).astype(np.int32)), pa.array((held % BANDS).astype(np.int32)), pa.array(count[held]), *[pa.array(t) for t in totals]]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "perm", "_band", "_ng", *[f"_s{j}" for j in range(k)]])

    return sums


def _rows_of_bands(keys: list[str], k: int, permutations: int, seed: int):
    """Kernel: the rows of a block whose draw lies in a wanted band of its permutation."""
    shift = np.uint64(32 - (BANDS - 1).bit_length())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, profiles, draws = _block_draws(batch, i, k, permutations, seed)
                wanted = np.zeros((permutations, BANDS), bool)
                asked = batch.column("_wanted")[i].values
                wanted[asked.field("perm").to_numpy() - 1, asked.field("_band").to_numpy()] = True
                bands = (draws >> shift).astype(np.int64)
                perm, row = np.nonzero(np.take_along_axis(wanted, bands, axis=1))
                own = [batch.column(c).take(pa.array(np.full(len(perm), i))) for c in keys]
                numbers = [pa.array((perm + 1).astype(np.int32)), pa.array(bands[perm, row].astype(np.int32)), pa.array(draws[perm, row] / 2.0**32), pa.array(ids[row])]
                yield pa.RecordBatch.from_arrays([*own, *numbers, *[pa.array(profiles[row, j]) for j in range(k)]], names=[*keys, "perm", "_band", "_u", "id", *[f"c{j}" for j in range(k)]])

    return rows


def top_shift(df: DataFrame, keys: list[str], dose: str, parts: list[str]) -> DataFrame:
    """Part with the largest absolute slope on dose per key."""
    slopes = df.groupBy(*keys).agg(*[F.regr_slope(F.col(c), F.col(dose)).alias(c) for c in parts])
    rows = F.array(*[F.struct(F.abs(F.col(c)).alias("size"), F.lit(c).alias("part"), F.col(c).alias("slope")) for c in parts])
    best = F.array_max(rows)
    return slopes.select(*keys, best["part"].alias("top_part"), best["slope"].alias("top_slope"))


def pca_by_key(df: DataFrame, keys: list[str], features: list[str], k: int = 2, least: int = 4) -> DataFrame:
    """Rows with their scores ``pc1``.. on the first components of the standardised features of their key, and ``explained1``.. of the key.

    Means, deviations and correlations are one aggregate; only a key's few moments meet the eigen solve, in batches; scores are computed
    where the rows are. A component's first loading that is not 0 is positive. A constant feature adds nothing. Rows with a missing
    feature and keys of fewer than ``least`` rows are left out; components beyond the number of features have score 0.
    """
    complete, m = df.where(known(*features)), len(features)
    pairs = [(i, j) for i in range(m) for j in range(i + 1, m)]
    moments = complete.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_m{i}") for i, c in enumerate(features)], *[F.stddev_samp(c).alias(f"_s{i}") for i, c in enumerate(features)],
        *[F.covar_samp(features[i], features[j]).alias(f"_c{i}_{j}") for i, j in pairs],
    ).where(F.col("_n") >= least)
    shape = _key_schema(df, keys) + ", _mean array<double>, _scale array<double>, _load array<array<double>>, _share array<double>"
    rows = complete.join(moments.mapInPandas(_components(keys, m, k), shape), keys)
    z = [F.coalesce(F.try_divide(F.col(c) - F.get("_mean", F.lit(i)), F.get("_scale", F.lit(i))), F.lit(0.0)) for i, c in enumerate(features)]
    scores = [sum((z[i] * F.get(F.get("_load", F.lit(c)), F.lit(i)) for i in range(m)), F.lit(0.0)).alias(f"pc{c + 1}") for c in range(k)]
    return rows.select(*df.columns, *scores, *[F.get("_share", F.lit(c)).alias(f"explained{c + 1}") for c in range(k)])


def _components(keys: list[str], m: int, k: int):
    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            scale = np.nan_to_num(np.stack([frame[f"_s{i}"].to_numpy(float) for i in range(m)], axis=1))
            table = np.zeros((len(frame), m, m))
            for i in range(m):
                table[:, i, i] = scale[:, i] > 0
                for j in range(i + 1, m):
                    spread = scale[:, i] * scale[:, j]
                    table[:, i, j] = table[:, j, i] = np.divide(frame[f"_c{i}_{j}"].to_numpy(float), spread, out=np.zeros(len(frame)), where=spread > 0)
            values, vectors = np.linalg.eigh(table)
            values, vectors = np.maximum(values[:, ::-1], 0), vectors[:, :, ::-1]
            total = values.sum(axis=1, keepdims=True)
            share, load = np.zeros((len(frame), k)), np.zeros((len(frame), k, m))
            some = min(k, m)
            share[:, :some] = np.divide(values, total, out=np.zeros_like(values), where=total > 0)[:, :some]
            load[:, :some] = vectors.transpose(0, 2, 1)[:, :some]
            first = np.take_along_axis(load, (np.abs(load) > 1e-9).argmax(axis=2)[:, :, None], axis=2)
            load = load * np.where(first < 0, -1.0, 1.0)
            out = frame[keys].copy()
            out["_mean"] = list(np.stack([frame[f"_m{i}"].to_numpy(float) for i in range(m)], axis=1))
            out["_scale"], out["_load"], out["_share"] = list(scale), [list(x) for x in load], list(share)
            yield out

    return solve


def with_pass_only(df: DataFrame, passed: str, variant: str = "variant") -> DataFrame:
    """Every row under ``all``, and once more under ``pass`` where it passed."""
    return df.withColumn(variant, F.explode(F.when(F.col(passed), F.array(F.lit("all"), F.lit("pass"))).otherwise(F.array(F.lit("all")))))


def qc_pca(df: DataFrame, features: list[str], k: int = 2) -> tuple[DataFrame, list[float]]:
    """Scores on the first standardised components and their explained variance; the first feature's loading is positive."""
    from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    valid = VectorAssembler(inputCols=features, outputCol="_raw").transform(df.dropna(subset=features))
    scaled = StandardScaler(inputCol="_raw", outputCol="_std", withMean=True, withStd=True).fit(valid).transform(valid)
    model = PCA(k=k, inputCol="_std", outputCol="_pc").fit(scaled)
    scores = model.transform(scaled).withColumn("_pc", vector_to_array("_pc"))
    sign = np.where(model.pc.toArray()[0] < 0, -1.0, 1.0)
    named = scores.select(*df.columns, *[(F.col("_pc")[i] * F.lit(float(sign[i]))).alias(f"pc{i + 1}") for i in range(k)])
    return named, [float(v) for v in model.explainedVariance]
