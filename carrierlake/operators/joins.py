"""Lookup, merge and entity joins with their audits."""

from pyspark.sql import Column, DataFrame, Window, functions as F


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in the given total order; rows are compared, never gathered."""
    best = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(best)).where("_place = 1").drop("_place")


def inner_first(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """Inner join after keeping the first row per key on both sides."""
    return keep_best(left, keys, left_order).join(keep_best(right, keys, right_order), keys)


def attach_lookup(df: DataFrame, lookup: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """Replace the lookup's columns in ``df`` by fresh ones; unmatched rows take the defaults."""
    fresh = [c for c in lookup.columns if c not in keys]
    return df.drop(*fresh).join(lookup, keys, "left").fillna(defaults)


def lossless_merge(master: DataFrame, table: DataFrame, key: str, prefix: str, ordinal: str) -> DataFrame:
    """Left join of a clinical table on its own key without losing or adding master rows.

    Every field is prefixed. A key with several candidate rows keeps the first by ``ordinal``
    and is marked ambiguous; the candidate count is kept.
    """
    names = [c for c in table.columns if c not in (key, ordinal)]
    row = F.struct(*[F.col(c).alias(f"{prefix}{c}") for c in names])
    one = table.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min_by(row, F.col(ordinal)).alias("_first"))
    joined = master.join(one, key, "left").select("*", *[F.col(f"_first.{prefix}{c}") for c in names])
    n = F.coalesce("_n", F.lit(0))
    status = F.when(n == 0, "unmatched").when(n == 1, "matched").otherwise("ambiguous")
    return joined.select(
        *master.columns, *[f"{prefix}{c}" for c in table.columns if c not in (key, ordinal)],
        n.alias(f"{prefix}candidates"), status.alias(f"{prefix}status"),
    )


def merge_audit(merged: DataFrame, table: DataFrame, key: str, status: str) -> dict[str, DataFrame]:
    """Rows and distinct ids per status, the unmatched ids, and the ids only the table has."""
    return {
        "status": merged.groupBy(F.col(status).alias("status")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("ids")),
        "unmatched": merged.where(F.col(status) == "unmatched").select(key).distinct(),
        "table_only": table.select(key).distinct().join(merged.select(key).distinct(), key, "left_anti"),
    }


def resolve_entities(left: DataFrame, entities: DataFrame, aliases: DataFrame, code: str, entity: str, name: str) -> DataFrame:
    """Direct code first, then alias; exactly one candidate is a match, more are ambiguous.

    ``left`` has ``code`` and ``name``; ``entities`` has ``entity`` and ``code``; ``aliases`` has
    ``entity`` and ``alias``. Candidates are counted, only the smallest is carried.
    """
    count = [F.countDistinct(entity).alias("_n"), F.min(entity).alias("_e")]
    direct = entities.where(F.col(code).isNotNull()).groupBy(code).agg(*count)
    by_alias = aliases.groupBy(F.col("alias").alias(name)).agg(*count)
    joined = left.join(direct.withColumnsRenamed({"_n": "_dn", "_e": "_de"}), code, "left").join(by_alias, name, "left")
    n = F.coalesce("_dn", "_n", F.lit(0))
    return joined.select(
        *left.columns,
        F.when(n == 1, F.coalesce("_de", "_e")).alias(entity),
        n.alias("candidates"),
        F.when(F.col("_dn").isNotNull(), "code").when(F.col("_n").isNotNull(), "alias").otherwise("none").alias("match_by"),
        F.when(n == 0, "unmatched").when(n == 1, "matched").otherwise("ambiguous").alias("match_status"),
    )


def outer_layers(a: DataFrame, b: DataFrame, keys: list[str], shared: list[str], names: tuple[str, str]) -> DataFrame:
    """Full outer merge of two layers: shared fields coalesced, presence flags added."""
    left = a.withColumnsRenamed({c: f"_a_{c}" for c in shared}).withColumn("_in_a", F.lit(True))
    right = b.withColumnsRenamed({c: f"_b_{c}" for c in shared}).withColumn("_in_b", F.lit(True))
    joined = left.join(right, keys, "full_outer")
    rest = [c for c in a.columns + b.columns if c not in keys + shared]
    return joined.select(
        *keys, *rest, *[F.coalesce(f"_a_{c}", f"_b_{c}").alias(c) for c in shared],
        F.col("_in_a").isNotNull().alias(f"in_{names[0]}"), F.col("_in_b").isNotNull().alias(f"in_{names[1]}"),
    )


def prioritised_match(base: DataFrame, candidates: DataFrame, key: str, levels: list[str], value: str) -> DataFrame:
    """Value from the first key level that hits; ties inside a level take the smallest value.

    Each level reduces the candidates to one row per level key before it joins.
    """
    out = base
    for i, level in enumerate(levels):
        best = candidates.where(F.col(level).isNotNull()).groupBy(level).agg(F.min(value).alias(f"_v{i}"))
        out = out.join(best, level, "left")
    hits = [F.col(f"_v{i}") for i in range(len(levels))]
    named = F.coalesce(*[F.when(h.isNotNull(), F.lit(name)) for h, name in zip(hits, levels)])
    return out.select(*base.columns, F.coalesce(*hits).alias(value), named.alias("matched_on"))


def whitelist_filter(df: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """Rows whose id, rs id, coordinate key or position is listed; one flag join per list."""
    out, flags = df, F.lit(False)
    for i, (column, listed) in enumerate(lists.items()):
        out = out.join(listed.select(column).distinct().withColumn(f"_f{i}", F.lit(True)), column, "left")
        flags = flags | F.coalesce(f"_f{i}", F.lit(False))
    return out.where(flags).select(*df.columns)


def key_flags(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of two tables with membership flags: union, intersection and differences in one pass."""
    tagged = a.select(key, F.lit(True).alias("_a"), F.lit(False).alias("_b")).unionByName(
        b.select(key, F.lit(False).alias("_a"), F.lit(True).alias("_b"))
    )
    return tagged.groupBy(key).agg(F.bool_or("_a").alias("in_a"), F.bool_or("_b").alias("in_b"))


def validate(df: DataFrame, required: list[str], allowed: dict[str, list] = {}, percent: list[str] = [], group: str | None = None) -> DataFrame:
    """One row per rule with the number of violations, from one aggregate pass."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    checks = {f"null:{c}": F.count_if(F.col(c).isNull()) for c in required}
    checks |= {f"allowed:{c}": F.count_if(F.col(c).isNotNull() & ~F.col(c).isin(v)) for c, v in allowed.items()}
    checks |= {f"percent:{c}": F.count_if(~F.col(c).between(0, 100)) for c in percent}
    checks["rows"] = F.count(F.lit(1))
    if group:
        checks[f"groups:{group}"] = F.countDistinct(group)
    counts = df.agg(*[e.alias(f"c{i}") for i, e in enumerate(checks.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"c{i}").alias("count")) for i, n in enumerate(checks)])
    return counts.select(F.inline(rows))


def restrict_panel(df: DataFrame, filters: dict[str, list]) -> DataFrame:
    """Rows that every filter of a present column keeps; see ``panel_report`` for what each does alone."""
    for column, values in filters.items():
        if column in df.columns:
            df = df.where(F.col(column).isin(values))
    return df


def panel_report(df: DataFrame, filters: dict[str, list]) -> DataFrame:
    """Kept and total rows per filter, with its status."""
    known = {c: v for c, v in filters.items() if c in df.columns}
    report = [
        F.struct(
            F.lit(c).alias("filter"), F.lit("applied" if c in known else "column_absent").alias("filter_status"),
            (F.count_if(F.col(c).isin(v)) if c in known else F.count(F.lit(1))).alias("kept"), F.count(F.lit(1)).alias("total"),
        )
        for c, v in filters.items()
    ]
    return df.agg(F.array(*report).alias("_r")).select(F.inline("_r"))


def drop_sparse_columns(df: DataFrame, limit: float = 0.99, protected: list[str] = []) -> DataFrame:
    """Leave out columns whose null share reaches the limit; the shares take one pass."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in df.columns]).first().asDict()
    return df.select(*[c for c in df.columns if c in protected or (shares[c] is not None and shares[c] < limit)])


def stack_blocks(df: DataFrame, keys: list[str], blocks: list[dict[str, str]], label: str = "block") -> DataFrame:
    """Side-by-side column blocks under each other: one projection per block, then a union."""
    parts = [
        df.select(*keys, F.lit(i + 1).alias(label), *[F.col(old).alias(new) for new, old in block.items()])
        for i, block in enumerate(blocks)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def collapse_replicates(df: DataFrame, keys: list[str], order: Column, columns: list[str]) -> DataFrame:
    """First valid value per column after ranking the rows of a key; row count and mixed flags."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("source_rows"),
        *[F.min(F.when(F.col(c).isNotNull(), F.struct(order.alias("o"), F.col(c).alias("v"))))["v"].alias(c) for c in columns],
        *[(F.min(c) != F.max(c)).alias(f"{c}_mixed") for c in columns],
    )
