"""Rank tests, regressions and survival over order lines, customers and suppliers."""

from pyspark.sql import functions as F

from carrierlake.operators import compare, ranking, ranktests, regression, survival
from carrierlake.plans.registry import cox_sql, effect_sql, logit_sql, normal_sql, query, rounded, student_sql, with_sql

LINES = """lines AS (SELECT p_brand AS k, l_quantity AS v, l_returnflag = 'R' AS f, l_linestatus || l_returnflag AS g, l_extendedprice AS price
    FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def lines(t):
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("p_brand").alias("k"), F.col("l_quantity").alias("v"), (F.col("l_returnflag") == "R").alias("f"),
        F.concat("l_linestatus", "l_returnflag").alias("g"), F.col("l_extendedprice").alias("price"),
    )


RANKED = """ranked AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY v) + (count(*) OVER (PARTITION BY {k}, v) - 1) / 2.0 AS r FROM {src})"""


@query(
    "average_rank",
    f"WITH {LINES}, {RANKED.format(k='k', src='lines')} SELECT k, v, f, r::DOUBLE AS avg_rank, count(*) AS n FROM ranked GROUP BY 1, 2, 3, 4",
)
def _avg_rank(t):
    out = ranking.attach_ranks(lines(t).select("k", "v", "f"), ["k"], "v")
    return out.groupBy("k", "v", "f", "avg_rank").agg(F.count(F.lit(1)).alias("n"))


@query(
    "quantiles",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, " + ", ".join(
        f"round(quantile_cont(l_extendedprice, {q}), 6) AS {n}" for n, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))
    ) + " FROM lineitem GROUP BY 1, 2",
)
def _quantiles(t):
    df = t.lineitem.select("l_returnflag", "l_linestatus", "l_extendedprice")
    return rounded(ranking.quantiles(df, ["l_returnflag", "l_linestatus"], "l_extendedprice", {"q25": 0.25, "median": 0.5, "q75": 0.75}))


U_SQL = """CASE WHEN abs(u - n1 * n2 / 2.0) > 0.5 THEN (abs(u - n1 * n2 / 2.0) - 0.5)
    / sqrt(n1::DOUBLE * n2 / 12.0 * (n1 + n2 + 1 - ties / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))) ELSE 0.0 END"""


@query(
    "mann_whitney",
    f"""WITH {LINES}, {RANKED.format(k='k', src='lines')}, tie AS (SELECT k, sum(c * c * c - c)::DOUBLE AS ties FROM (SELECT k, v, count(*) AS c FROM lines GROUP BY 1, 2) GROUP BY 1),
      s AS (SELECT k, count(*) FILTER (f) AS n1, count(*) FILTER (NOT f) AS n2, sum(r) FILTER (f) - count(*) FILTER (f) * (count(*) FILTER (f) + 1) / 2.0 AS u,
        {", ".join(f"quantile_cont(v, {q}) FILTER ({c}) AS {n}_{side}" for side, c in (("carrier", "f"), ("rest", "NOT f")) for n, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)))}
        FROM ranked GROUP BY 1), z AS (SELECT *, {U_SQL} AS z FROM s JOIN tie USING (k))
    SELECT k, n1, n2, round(u, 6)::DOUBLE AS u, round(1 - 2 * u / (n1::DOUBLE * n2), 6) AS rank_biserial, round({normal_sql('z')}, 6) AS p_value,
      q25_carrier, median_carrier, q75_carrier, q25_rest, median_rest, q75_rest FROM z""",
)
def _mw(t):
    return rounded(ranktests.mann_whitney(lines(t), ["k"], "v", "f"))


VALUES = """vals AS (SELECT c.sample, p.p_type AS var, sum(l_quantity) AS v FROM purchases p JOIN samples c USING (sample) GROUP BY 1, 2)"""


def purchase_values(t):
    """Units of each part type per sample: the outcome or expression table in long form."""
    return t.purchases().groupBy("sample", F.col("p_type").alias("var")).agg(F.sum("l_quantity").alias("value"))


@query(
    "carrier_rank_tests",
    with_sql("samples purchases calls", "").rstrip() + f""", {VALUES}, {RANKED.format(k='var', src='vals')},
      tie AS (SELECT var, sum(c * c * c - c)::DOUBLE AS ties, sum(c) AS total FROM (SELECT var, v, count(*) AS c FROM vals GROUP BY 1, 2) GROUP BY 1),
      s AS (SELECT variant, var, count(*) AS n1, sum(r) - count(*) * (count(*) + 1) / 2.0 AS u FROM ranked JOIN calls USING (sample) GROUP BY 1, 2),
      z AS (SELECT *, {U_SQL} AS z FROM (SELECT s.*, ties, (total - n1)::BIGINT AS n2 FROM s JOIN tie USING (var)) WHERE n1 >= 3 AND n2 >= 3)
    SELECT variant, var, n1, n2, round(u, 6)::DOUBLE AS u, round(1 - 2 * u / (n1::DOUBLE * n2), 6) AS rank_biserial, round({normal_sql('z')}, 6) AS p_value FROM z""",
)
def _carrier_ranks(t):
    return rounded(ranktests.carrier_rank_tests(purchase_values(t), t.calls(), ["var"], "variant"))


@query(
    "spearman",
    f"""WITH {LINES}, a AS (SELECT *, rank() OVER (PARTITION BY k ORDER BY v) + (count(*) OVER (PARTITION BY k, v) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY k ORDER BY price) + (count(*) OVER (PARTITION BY k, price) - 1) / 2.0 AS ry FROM lines),
      c AS (SELECT k, count(*) AS n, corr(rx, ry) AS rho FROM a GROUP BY 1)
    SELECT k, n, round(rho, 6) AS rho, round({student_sql('rho * sqrt((n - 2) / (1 - rho * rho))', '(n - 2)')}, 6) AS p_value FROM c""",
)
def _spearman(t):
    return rounded(ranktests.spearman(lines(t), ["k"], "v", "price"))


@query(
    "kruskal",
    f"""WITH {LINES}, {RANKED.format(k='k', src='lines')}, tie AS (SELECT k, sum(c * c * c - c)::DOUBLE AS ties, sum(c)::DOUBLE AS n FROM (SELECT k, v, count(*) AS c FROM lines GROUP BY 1, 2) GROUP BY 1),
      g AS (SELECT k, g, count(*) AS ng, sum(r) AS rg FROM ranked GROUP BY 1, 2), q AS (SELECT k, count(*) AS n_groups, sum(rg * rg / ng)::DOUBLE AS q FROM g GROUP BY 1),
      h AS (SELECT k, n, n_groups, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - ties / (n * n * n - n)) AS h FROM q JOIN tie USING (k))
    SELECT k, n::BIGINT AS n, n_groups, round(h, 6) AS h, round({normal_sql('sqrt(h)')} + sqrt(2 / pi()) * exp(-h / 2) * (sqrt(h) + pow(sqrt(h), 3) / 3), 6) AS p_value FROM h""",
)
def _kruskal(t):
    return rounded(ranktests.kruskal(lines(t), ["k"], "v", "g"))


REGRESSION = with_sql("samples purchases calls", "").rstrip() + f""", {VALUES}, xy AS (SELECT b.variant, v.var, v.sample, v.v AS y, coalesce(dosage, 0) AS x
    FROM vals v CROSS JOIN (SELECT DISTINCT variant FROM calls) b LEFT JOIN calls c ON c.sample = v.sample AND c.variant = b.variant),
  reg AS (SELECT variant, var, count(*) AS n, count(*) FILTER (x = 0) AS n_dose0, count(*) FILTER (x = 1) AS n_dose1, count(*) FILTER (x = 2) AS n_dose2,
    regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, corr(y, x) AS r, sqrt((1 - corr(y, x) ** 2) * regr_syy(y, x) / regr_sxx(y, x) / (count(*) - 2)) AS se
    FROM xy GROUP BY 1, 2)"""


@query(
    "dose_regression",
    REGRESSION + f""" SELECT variant, var, n, n_dose0, n_dose1, n_dose2, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r, 6) AS r, round(se, 6) AS se,
      round({student_sql('slope / se', '(n - 2)')}, 6) AS p_value, CASE WHEN slope > 0 THEN 'Higher_with_dosage' ELSE 'Lower_with_dosage' END AS direction FROM reg""",
)
def _dose(t):
    return rounded(regression.dose_regression(purchase_values(t), t.calls(), ["var"], "variant"))


def late_rows(t):
    """One row per order: late ship of any line as outcome, high priority as exposure, price and size as covariates."""
    lag = F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date"))
    return (
        t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
        .agg(F.max(lag).alias("lag"), F.count(F.lit(1)).cast("double").alias("n_lines"))
        .select(
            F.col("o_orderstatus").alias("key"), (F.col("lag") > 80).cast("int").alias("late"),
            (F.col("o_orderpriority") < "3").cast("int").alias("urgent"), F.round(F.col("o_totalprice") / 1000).alias("price"), "n_lines",
        )
    )


@query(
    "logit_unadjusted",
    """WITH o AS (SELECT o_orderkey, any_value(o_orderstatus) AS key, CASE WHEN max(datediff('day', o_orderdate::DATE, l_shipdate::DATE)) > 80 THEN 1 ELSE 0 END AS late,
        CASE WHEN any_value(o_orderpriority) < '3' THEN 1 ELSE 0 END AS urgent FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1),
      c AS (SELECT key, count(*) AS n, sum(late)::BIGINT AS events, count(*) FILTER (late = 1 AND urgent = 1)::DOUBLE AS a, count(*) FILTER (late = 0 AND urgent = 1)::DOUBLE AS b,
        count(*) FILTER (late = 1 AND urgent = 0)::DOUBLE AS c, count(*) FILTER (late = 0 AND urgent = 0)::DOUBLE AS d FROM o GROUP BY 1)
    SELECT key, n, events, round(ln(a * d / (b * c)), 6) AS beta, round(sqrt(1 / a + 1 / b + 1 / c + 1 / d), 6) AS se, round(a * d / (b * c), 6) AS odds_ratio FROM c""",
)
def _logit(t):
    out = regression.logit_by_key(late_rows(t), ["key"], "late", "urgent")
    return rounded(out.select("key", "n", "events", "beta", "se", "odds_ratio"))


LATE = """o AS (SELECT any_value(o_orderstatus) AS key, CASE WHEN max(datediff('day', o_orderdate::DATE, l_shipdate::DATE)) > 80 THEN 1 ELSE 0 END AS late,
      CASE WHEN any_value(o_orderpriority) < '3' THEN 1.0 ELSE 0.0 END AS urgent, round(any_value(o_totalprice) / 1000) / 100 AS price, count(*) / 4.0 AS n_lines
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey),
    g AS (SELECT key, count(*) AS n, sum(late)::BIGINT AS events FROM o GROUP BY 1 HAVING sum(late) >= 10 AND count(*) - sum(late) >= 1 AND count(DISTINCT urgent) = 2)"""
ADJUSTED = {"price": ["price"], "lines": ["n_lines"], "price_lines": ["price", "n_lines"]}


def late_fit_sql(name: str, covariates: list[str]) -> str:
    features = ["1.0", *covariates, "urgent"]
    source = f"s_{name} AS (SELECT key, {', '.join(f'{c} AS f{i}' for i, c in enumerate(features))}, count(*) AS n, sum(late) AS e FROM o JOIN g USING (key) GROUP BY ALL)"
    return source + ", " + logit_sql(f"fit_{name}", f"s_{name}", "key", len(features), 25)


@query(
    "logit_adjusted",
    f"WITH RECURSIVE {LATE}, " + ", ".join(late_fit_sql(name, own) for name, own in ADJUSTED.items()) + " " + " UNION ALL ".join(
        f"SELECT key, n, events, {effect_sql('odds_ratio', f'b{len(own) + 1}')}, '{name}' AS model FROM fit_{name} JOIN g USING (key) WHERE pass = 25" for name, own in ADJUSTED.items()
    ),
)
def _logit_adjusted(t):
    return rounded(regression.adjusted_models(late_rows(t), ["key"], "late", "urgent", ADJUSTED), 4)


FIRTH = with_sql("samples purchases calls arms counts", "").rstrip().replace("WITH", "WITH RECURSIVE", 1) + """, cells AS (SELECT variant, case_callable + control_callable AS n, case_callable AS events,
      case_wt + control_wt AS n0, case_het + control_het AS n1, case_hom + control_hom AS n2, case_wt AS y0, case_het AS y1, case_hom AS y2
      FROM geno WHERE comparison = 'All' AND case_callable > 0 AND case_het + control_het + case_hom + control_hom > 0 AND case_callable + control_callable >= 6),
    fit AS (SELECT variant, 0 AS pass, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS v1 FROM cells
      UNION ALL SELECT variant, pass + 1, b0 + (i00 * u0 + i01 * u1), b1 + (i01 * u0 + i11 * u1), i11 FROM (
        SELECT *, y0 + y1 + y2 - n0 * p0 - n1 * p1 - n2 * p2 + n0 * g0 * (0.5 - p0) + n1 * g1 * (0.5 - p1) + n2 * g2 * (0.5 - p2) AS u0,
          y1 + 2 * y2 - n1 * p1 - 2 * n2 * p2 + n1 * g1 * (0.5 - p1) + 2 * n2 * g2 * (0.5 - p2) AS u1 FROM (
          SELECT *, w0 * i00 AS g0, w1 * (i00 + 2 * i01 + i11) AS g1, w2 * (i00 + 4 * i01 + 4 * i11) AS g2 FROM (
            SELECT *, h11 / det AS i00, -h01 / det AS i01, h00 / det AS i11 FROM (
              SELECT *, h00 * h11 - h01 * h01 AS det FROM (
                SELECT *, n0 * w0 + n1 * w1 + n2 * w2 AS h00, n1 * w1 + 2 * n2 * w2 AS h01, n1 * w1 + 4 * n2 * w2 AS h11 FROM (
                  SELECT *, p0 * (1 - p0) AS w0, p1 * (1 - p1) AS w1, p2 * (1 - p2) AS w2 FROM (
                    SELECT fit.*, n0, n1, n2, y0, y1, y2, 1 / (1 + exp(-b0)) AS p0, 1 / (1 + exp(-b0 - b1)) AS p1, 1 / (1 + exp(-b0 - 2 * b1)) AS p2
                    FROM fit JOIN cells USING (variant) WHERE pass < 40))))))))
    SELECT variant, n::BIGINT AS n, events::BIGINT AS events, round(b1, 4) AS beta, round(sqrt(v1), 4) AS se FROM fit JOIN cells USING (variant) WHERE pass = 40"""


@query("firth_logit", FIRTH)
def _firth(t):
    """All samples: the wild type enters by its count."""
    counts = compare.genotype_counts(t.calls(), t.samples()).where("comparison = 'All'")
    out = regression.firth_by_key(regression.dose_rows(counts, ["variant"]), ["variant"], "case", "dosage", weight="n")
    return rounded(out.select("variant", F.col("n").cast("bigint").alias("n"), "events", "beta", "se"), 4)


@query("dose_risk", FIRTH.replace("SELECT variant, n::BIGINT AS n, events::BIGINT AS events, round(b1, 4) AS beta, round(sqrt(v1), 4) AS se FROM fit", "SELECT variant, round(exp(b1), 3) AS odds_ratio, 'penalised' AS model FROM fit"))
def _dose_risk(t):
    counts = compare.genotype_counts(t.calls(), t.samples()).where("comparison = 'All'")
    return rounded(regression.dose_risk(counts, ["variant"]).select("variant", "odds_ratio", "model"), 3)


FOLLOW = """follow AS (SELECT o_custkey AS sample, datediff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS days,
    CASE WHEN arg_max(o_orderstatus, struct_pack(d := o_orderdate, k := o_orderkey)) = 'F' THEN 1 ELSE 0 END AS event FROM orders GROUP BY 1),
  surv AS (SELECT cohort, tissue, days, event FROM follow JOIN samples USING (sample) WHERE days > 0)"""


# The product-limit curve counts samples of one day, too.
EVERY_FOLLOW = FOLLOW.replace(" WHERE days > 0", "")


def follow_up(t):
    """Days from first to last order; the event is a finished last order."""
    last = F.max(F.struct("o_orderdate", "o_orderkey", "o_orderstatus"))["o_orderstatus"]
    return (
        t.orders.groupBy(F.col("o_custkey").alias("sample"))
        .agg(
            F.datediff(F.max("o_orderdate").cast("date"), F.min("o_orderdate").cast("date")).alias("days"), (last == "F").cast("int").alias("event"),
            F.avg("o_totalprice").alias("spend"), F.count(F.lit(1)).alias("n_orders"),
        )
        .join(t.samples(), "sample")
    )


@query(
    "km_table",
    with_sql("samples", "").rstrip() + f""", {EVERY_FOLLOW}, steps AS (SELECT cohort, tissue, days, count(*) AS leaving, sum(event)::BIGINT AS events FROM surv GROUP BY 1, 2, 3),
      r AS (SELECT *, sum(leaving) OVER (PARTITION BY cohort, tissue ORDER BY days DESC)::BIGINT AS at_risk FROM steps)
    SELECT cohort, tissue, days, at_risk, events, round(CASE WHEN sum(CASE WHEN events = at_risk THEN 1 ELSE 0 END) OVER w > 0 THEN 0.0
      ELSE exp(sum(CASE WHEN events = at_risk THEN 0.0 ELSE ln(1 - events / at_risk::DOUBLE) END) OVER w) END, 6) AS survival
    FROM r WINDOW w AS (PARTITION BY cohort, tissue ORDER BY days)""",
)
def _km(t):
    return rounded(survival.km_table(follow_up(t), ["cohort", "tissue"], "days", "event"))


@query(
    "logrank",
    with_sql("samples", "").rstrip() + f""", {FOLLOW}, steps AS (SELECT cohort, days, sum(event)::DOUBLE AS d, count(*) FILTER (tissue = 'Tumour') AS l1, count(*) AS l,
        sum(event) FILTER (tissue = 'Tumour') AS d1 FROM surv GROUP BY 1, 2),
      r AS (SELECT *, sum(l) OVER w::DOUBLE AS n, sum(l1) OVER w::DOUBLE AS n1 FROM steps WINDOW w AS (PARTITION BY cohort ORDER BY days DESC)),
      s AS (SELECT cohort, sum(coalesce(d1, 0))::BIGINT AS o1, (sum(d) - sum(coalesce(d1, 0)))::BIGINT AS o0, sum(d * n1 / n) AS e1, sum(d) - sum(d * n1 / n) AS e0,
        sum(CASE WHEN n > 1 THEN d * n1 * (n - n1) * (n - d) / (n * n * (n - 1)) ELSE 0 END) AS v FROM r WHERE d > 0 GROUP BY 1)
    SELECT cohort, o1 AS observed_0, o0 AS observed_1, round(e1, 6) AS expected_0, round(e0, 6) AS expected_1, round((o1 - e1) ** 2 / v, 6) AS statistic,
      round({normal_sql('(o1 - e1) / sqrt(v)')}, 6) AS p_value FROM s""".replace("OVER w::DOUBLE", "OVER w"),
)
def _logrank(t):
    return rounded(survival.logrank_by_key(follow_up(t), ["cohort"], "days", "event", "tissue", ["Tumour", "Healthy"]))


COX = with_sql("samples", "").rstrip().replace("WITH", "WITH RECURSIVE", 1) + """, follow AS (SELECT o_custkey AS sample, datediff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS days, count(*) / 10.0 AS load,
      CASE WHEN arg_max(o_orderstatus, struct_pack(d := o_orderdate, k := o_orderkey)) = 'F' THEN 1 ELSE 0 END AS event FROM orders GROUP BY 1),
    sv AS (SELECT cohort, days AS t, event AS e, load, (tissue = 'Tumour')::INT::DOUBLE AS f, sample FROM follow JOIN samples USING (sample) WHERE days > 0),
    kg AS (SELECT cohort, count(*) AS n, sum(e)::BIGINT AS events, avg(load) AS ml, avg(f) AS mf FROM sv GROUP BY 1 HAVING sum(e) >= 3 AND count(DISTINCT f) = 2)"""


@query(
    "cox_by_key",
    COX + ", s1 AS (SELECT cohort, t, e, f - mf AS f0 FROM sv JOIN kg USING (cohort)), s2 AS (SELECT cohort, t, e, load - ml AS f0, f - mf AS f1 FROM sv JOIN kg USING (cohort)), "
    + cox_sql("c1", "s1", "cohort", 1) + ", " + cox_sql("c2", "s2", "cohort", 2, 0.1)
    + f""" SELECT cohort, n, events, {effect_sql('hazard_ratio', 'b0')}, 'unadjusted' AS model FROM c1 JOIN kg USING (cohort) WHERE pass = 15 AND abs(b0) < 10
      UNION ALL SELECT cohort, n, events, {effect_sql('hazard_ratio', 'b1')}, 'adjusted' FROM c2 JOIN kg USING (cohort) WHERE pass = 15 AND abs(b1) < 10""",
)
def _cox(t):
    rows = follow_up(t).withColumn("case", (F.col("tissue") == "Tumour").cast("int")).withColumn("load", F.col("n_orders") / 10.0)
    plain = survival.cox_by_key(rows, ["cohort"], "days", "event", ["case"]).withColumn("model", F.lit("unadjusted"))
    adjusted = survival.cox_by_key(rows, ["cohort"], "days", "event", ["case", "load"], penalty=0.1).withColumn("model", F.lit("adjusted"))
    return rounded(plain.unionByName(adjusted).where("converged and not clipped"), 4)


FALLBACK = {"load+spend": ["load", "spend"], "load": ["load"], "unadjusted": []}


def fallback_fit_sql(level: int, covariates: list[str]) -> str:
    """Fit of one covariate set over the rows that know it, where an arm of each kind has an event and someone without one of its value."""
    name, features = f"v{level}", [*covariates, "f"]
    whole = " AND ".join(f"{c} IS NOT NULL" for c in covariates) or "true"
    kept = f"""k{level} AS (SELECT cohort, count(*) AS n, sum(e)::BIGINT AS events, {', '.join(f'avg({c}) AS m_{c}' for c in features)} FROM sv WHERE {whole} GROUP BY 1
        HAVING count(*) >= 6 AND sum(e) >= 3 AND min(f) FILTER (e = 1) < max(f) AND max(f) FILTER (e = 1) > min(f))"""
    source = f"s{level} AS (SELECT cohort, t, e, {', '.join(f'{c} - m_{c} AS f{i}' for i, c in enumerate(features))} FROM sv JOIN k{level} USING (cohort) WHERE {whole})"
    last = f"b{len(covariates)}"
    done = f"r{level} AS (SELECT cohort, n, events, {last} AS b, v, {level} AS level FROM {name} JOIN k{level} USING (cohort) WHERE pass = 15 AND abs({last}) < 10)"
    return ", ".join([kept, source, cox_sql(name, f"s{level}", "cohort", len(features)), done])


@query(
    "cox_with_fallback",
    with_sql("samples", "").rstrip().replace("WITH", "WITH RECURSIVE", 1)
    + """, follow AS (SELECT o_custkey AS sample, datediff('day', min(o_orderdate)::DATE, max(o_orderdate)::DATE) AS days, count(*) / 10.0 AS load, avg(o_totalprice) / 100000 AS spend,
      CASE WHEN arg_max(o_orderstatus, struct_pack(d := o_orderdate, k := o_orderkey)) = 'F' THEN 1 ELSE 0 END AS event FROM orders GROUP BY 1),
    sv AS (SELECT cohort, days AS t, event AS e, (tissue = 'Tumour')::INT::DOUBLE AS f, CASE WHEN cohort <> 'BUILDING' THEN load END AS load,
      CASE WHEN cohort <> 'BUILDING' AND cohort <> 'MACHINERY' THEN spend END AS spend FROM follow JOIN samples USING (sample) WHERE days > 0),
    tot AS (SELECT cohort, count(*) AS n_total FROM sv GROUP BY 1), """
    + ", ".join(fallback_fit_sql(i, own) for i, own in enumerate(FALLBACK.values()))
    + f""", best AS (SELECT * FROM (SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2) QUALIFY row_number() OVER (PARTITION BY cohort ORDER BY level) = 1)
    SELECT cohort, n, events, {effect_sql('hazard_ratio')}, n_total, {str(list(FALLBACK)).replace('[', 'list_extract([', 1)}, level + 1) AS adjustment FROM best JOIN tot USING (cohort)""",
)
def _cox_fallback(t):
    known_in = lambda names, c: F.when(~F.col("cohort").isin(names), F.col(c))
    rows = follow_up(t).withColumn("load", F.col("n_orders") / 10.0).withColumn("spend", F.col("spend") / 100000).select(
        "cohort", "days", "event", (F.col("tissue") == "Tumour").cast("int").alias("case"),
        known_in(["BUILDING"], "load").alias("load"), known_in(["BUILDING", "MACHINERY"], "spend").alias("spend"),
    )
    return rounded(survival.cox_with_fallback(rows, ["cohort"], "days", "event", "case", list(FALLBACK.values())), 4)
