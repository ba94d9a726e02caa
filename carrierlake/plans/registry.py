"""Query registry and the cohort stand-ins derived from the driver tables."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from carrierlake.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a Spark plan and, when SQL can express it, its oracle."""

    def keep(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return keep


class Tables:
    """Lazy access to the driver tables and to the cohort shapes built from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def samples(self) -> DataFrame:
        """Customers as samples: segment is the cohort, a low balance marks the case tissue."""
        return self.customer.select(
            F.col("c_custkey").alias("sample"),
            F.col("c_mktsegment").alias("cohort"),
            F.when(F.col("c_acctbal") < 2000, "Tumour").otherwise("Healthy").alias("tissue"),
        )

    def purchases(self) -> DataFrame:
        """One row per line: sample, order, status, dates, amounts and the part bought."""
        lines, orders = spread((self.lineitem, ["l_orderkey"]), (self.orders, ["o_orderkey"]))
        return (
            lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .join(self.part, F.col("l_partkey") == F.col("p_partkey"))
            .withColumnRenamed("o_custkey", "sample")
        )

    def calls(self, variant: str = "p_brand") -> DataFrame:
        """Carrier rows (sample, variant, dosage): 2 when bought in more than one order."""
        return (
            self.purchases()
            .groupBy("sample", F.col(variant).alias("variant"))
            .agg(F.when(F.min("l_orderkey") == F.max("l_orderkey"), 1).otherwise(2).alias("dosage"))
        )

    def phased(self) -> DataFrame:
        """Allele pair per sample and locus: any order with status F, any with status O."""
        status = F.col("o_orderstatus")
        return (
            self.purchases()
            .groupBy("sample", F.col("p_brand").alias("locus"))
            .agg(
                F.max(F.when(status == "F", 1).otherwise(0)).alias("a1"),
                F.max(F.when(status == "O", 1).otherwise(0)).alias("a2"),
            )
        )

    def rare_positions(self) -> DataFrame:
        """Sample, part as position, brand as gene, type as consequence class."""
        return self.purchases().select(
            "sample",
            F.col("p_brand").alias("gene"),
            F.col("p_partkey").alias("pos"),
            F.col("p_type").alias("kind"),
            F.col("p_size").alias("size"),
        )


# Shared SQL fragments of the oracles, one per stand-in above.
FRAGMENTS = {
    "samples": """samples AS (SELECT c_custkey AS sample, c_mktsegment AS cohort,
        CASE WHEN c_acctbal < 2000 THEN 'Tumour' ELSE 'Healthy' END AS tissue FROM customer)""",
    "purchases": """purchases AS (SELECT *, o_custkey AS sample FROM lineitem
        JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
    "calls": """calls AS (SELECT sample, p_brand AS variant,
        least(count(DISTINCT l_orderkey), 2) AS dosage FROM purchases GROUP BY 1, 2)""",
    "phased": """phased AS (SELECT sample, p_brand AS locus,
        max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS a1,
        max(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS a2 FROM purchases GROUP BY 1, 2)""",
    "arms": """arms AS (
        SELECT s.sample, s.cohort, s.tissue, c.comparison,
               CASE WHEN s.tissue = 'Tumour' THEN 1 ELSE 0 END AS is_case
        FROM samples s JOIN (SELECT DISTINCT cohort AS comparison FROM samples UNION ALL SELECT 'All') c
          ON s.tissue = 'Healthy' OR c.comparison = 'All' OR c.comparison = s.cohort)""",
    "counts": """counts AS (
        SELECT comparison, variant,
          count(*) FILTER (is_case = 1 AND dosage = 1) AS case_het,
          count(*) FILTER (is_case = 1 AND dosage = 2) AS case_hom,
          count(*) FILTER (is_case = 0 AND dosage = 1) AS control_het,
          count(*) FILTER (is_case = 0 AND dosage = 2) AS control_hom
        FROM arms JOIN calls USING (sample) GROUP BY 1, 2),
      sizes AS (SELECT comparison, sum(is_case) AS case_callable, sum(1 - is_case) AS control_callable
        FROM arms GROUP BY 1),
      geno AS (SELECT comparison, variant, case_het, case_hom, control_het, control_hom,
          case_callable - case_het - case_hom AS case_wt,
          control_callable - control_het - control_hom AS control_wt, case_callable, control_callable
        FROM counts JOIN sizes USING (comparison))""",
}


def with_sql(names: str, body: str) -> str:
    """Prefix a query with the named fragments (space separated) as WITH clauses."""
    parts = [FRAGMENTS.get(n, n) for n in names.split()] if names else []
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def log_choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma(({n}) - ({k}) + 1.0))"


def fisher_sql(a: str, b: str, c: str, d: str) -> str:
    """Two-sided exact p as one SQL expression over list functions."""
    r1, r2, c1 = f"({a} + {b})", f"({c} + {d})", f"({a} + {c})"
    lp = lambda k: f"({log_choose(r1, k)} + {log_choose(r2, f'({c1} - {k})')} - {log_choose(f'({r1} + {r2})', c1)})"
    ks = f"range(greatest(0, {c1} - {r2})::BIGINT, least({r1}, {c1})::BIGINT + 1)"
    return (
        f"least(1.0, list_sum(list_transform({ks}, lambda k: CASE WHEN exp({lp('k')}) <= exp({lp(a)}) * 1.0000001 "
        f"THEN exp({lp('k')}) ELSE 0.0 END)))"
    )


def normal_sql(z: str) -> str:
    """Two-sided normal tail by Simpson's rule on the density over [0, |z|]."""
    f = "exp(-0.5 * pow(i * least(abs({z}), 12.0) / 800.0, 2))".format(z=z)
    w = "CASE WHEN i = 0 OR i = 800 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
    total = f"list_sum(list_transform(range(0, 801), lambda i: ({w}) * {f}))"
    return f"greatest(0.0, 1.0 - 2.0 * {total} * (least(abs({z}), 12.0) / 2400.0) / sqrt(2.0 * pi()))"


def student_sql(t: str, dof: str) -> str:
    """Two-sided Student tail by Simpson's rule over the angle atan(t / sqrt(dof))."""
    angle = f"atan(abs({t}) / sqrt({dof}))"
    f = f"pow(cos(i * {angle} / 800.0), {dof} - 1)"
    w = "CASE WHEN i = 0 OR i = 800 THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END"
    total = f"list_sum(list_transform(range(0, 801), lambda i: ({w}) * {f}))"
    const = f"exp(lgamma(({dof} + 1) / 2.0) - lgamma({dof} / 2.0)) / sqrt(pi())"
    return f"greatest(0.0, 1.0 - 2.0 * {const} * {total} * {angle} / 2400.0)"


def bh_sql(source: str, p: str, family: str, out: str, columns: str = "*") -> str:
    """Adjusted p over a named source; ties take the highest rank."""
    part = f"PARTITION BY {family}" if family else ""
    return f"""SELECT {columns}, least(1.0, min(q_raw) OVER ({part} ORDER BY {p} DESC
        RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS {out} FROM (
        SELECT *, {p} * count({p}) OVER ({part}) / count({p}) OVER ({part} ORDER BY {p}
        RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q_raw FROM {source} WHERE {p} IS NOT NULL)"""


def _ordered_solve(p: int, g: str = "g", h: str = "h") -> str:
    """Select items that solve the p normal equations by LDL factors; ``move{i}``, and ``v`` as the variance of the last unknown."""
    out = []
    for j in range(p):
        out.append(f"{h}{j}_{j}" + "".join(f" - l{j}_{k} * l{j}_{k} * d{k}" for k in range(j)) + f" AS d{j}")
        out += [f"({h}{j}_{i}" + "".join(f" - l{i}_{k} * l{j}_{k} * d{k}" for k in range(j)) + f") / d{j} AS l{i}_{j}" for i in range(j + 1, p)]
    out += [f"{g}{i}" + "".join(f" - l{i}_{k} * y{k}" for k in range(i)) + f" AS y{i}" for i in range(p)]
    out += [f"y{i} / d{i}" + "".join(f" - l{k}_{i} * move{k}" for k in range(i + 1, p)) + f" AS move{i}" for i in reversed(range(p))]
    return ", ".join([*out, f"1 / d{p - 1} AS v_new"])


def logit_sql(name: str, source: str, keys: str, p: int, passes: int = 15) -> str:
    """Recursive CTE ``name`` (keys, pass, b0.., v): Newton's method over ``source`` (keys, f0.., n, e); the last feature is the exposure."""
    b, pairs = [f"b{i}" for i in range(p)], [(i, j) for i in range(p) for j in range(i, p)]
    eta = " + ".join(f"b{i} * f{i}" for i in range(p))
    sums = [f"sum((e - n * q) * f{i}) AS g{i}" for i in range(p)] + [f"sum(n * q * (1 - q) * f{i} * f{j}) AS h{i}_{j}" for i, j in pairs]
    start = ", ".join(f"0.0::DOUBLE AS {c}" for c in (*b, "v"))
    return f"""{name} AS (SELECT DISTINCT {keys}, 0 AS pass, {start} FROM {source}
      UNION ALL SELECT {keys}, pass + 1, {', '.join(f'b{i} + move{i}' for i in range(p))}, v_new FROM (SELECT *, {_ordered_solve(p)} FROM (
        SELECT {keys}, pass, {', '.join(b)}, {', '.join(sums)} FROM (SELECT *, 1 / (1 + exp(-({eta}))) AS q FROM {name} JOIN {source} USING ({keys}) WHERE pass < {passes}) GROUP BY ALL)))"""


def cox_sql(name: str, source: str, keys: str, p: int, penalty: float = 0.0, passes: int = 15) -> str:
    """Recursive CTE ``name`` (keys, pass, b0.., v): proportional hazards with Efron ties over ``source`` (keys, t, e, f0..); the last feature is the exposure."""
    b, pairs = [f"b{i}" for i in range(p)], [(i, j) for i in range(p) for j in range(i, p)]
    terms = {"": "r"} | {f"_{i}": f"r * f{i}" for i in range(p)} | {f"_{i}_{j}": f"r * f{i} * f{j}" for i, j in pairs}
    at = [f"sum({x}) AS a{k}, sum(e * {x}) AS m{k}" for k, x in terms.items()] + ["sum(e) AS d"] + [f"sum(e * f{i}) AS x{i}" for i in range(p)]
    num = lambda k: f"(s{k} - l / d * m{k})"
    once = lambda x: f"CASE WHEN l = 0 THEN {x} ELSE 0 END"
    sums = [f"sum({once(f'x{i} - {penalty} * d * b{i}')} - {num(f'_{i}')} / {num('')}) AS g{i}" for i in range(p)]
    sums += [
        f"sum({num(f'_{i}_{j}')} / {num('')} - {num(f'_{i}')} * {num(f'_{j}')} / {num('')} ** 2 + {once(f'{penalty if i == j else 0.0} * d')}) AS h{i}_{j}" for i, j in pairs
    ]
    start = ", ".join(f"0.0::DOUBLE AS {c}" for c in (*b, "v"))
    beta = ", ".join(b)
    return f"""{name} AS (SELECT DISTINCT {keys}, 0 AS pass, {start} FROM {source}
      UNION ALL SELECT {keys}, pass + 1, {', '.join(f'b{i} + move{i}' for i in range(p))}, v_new FROM (SELECT *, {_ordered_solve(p)} FROM (
        SELECT {keys}, pass, {beta}, {', '.join(sums)} FROM (
          SELECT *, {', '.join(f'sum(a{k}) OVER (PARTITION BY {keys} ORDER BY t DESC) AS s{k}' for k in terms)} FROM (
            SELECT {keys}, pass, {beta}, t, {', '.join(at)} FROM (SELECT *, exp({' + '.join(f'b{i} * f{i}' for i in range(p))}) AS r FROM {name} JOIN {source} USING ({keys}) WHERE pass < {passes}) GROUP BY ALL))
        JOIN (SELECT unnest(range(0, 400))::DOUBLE AS l) ties ON l < d GROUP BY ALL)))"""


def effect_sql(ratio: str, beta: str = "b", v: str = "v") -> str:
    """Select items of a fit: beta, se, ratio with its interval, flags and p."""
    se = f"sqrt({v})"
    return f"""round({beta}, 4) AS beta, round({se}, 4) AS se, round(exp({beta}), 4) AS {ratio}, round(exp({beta} - 1.96 * {se}), 4) AS ci_low, round(exp({beta} + 1.96 * {se}), 4) AS ci_high,
      false AS clipped, true AS converged, round({normal_sql(f'{beta} / {se}')}, 4) AS p_value"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for the value hash; everything else unchanged."""
    kinds = dict(df.dtypes)
    return df.select(
        *[F.round(F.col(c), digits).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns]
    )
