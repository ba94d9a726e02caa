"""Clinical categories by decision table, ordered codes, and haplotype dose against typed outcomes."""

from pyspark.sql import functions as F

from carrierlake.functions import clinical as rules
from carrierlake.operators import decisions, harmonise
from carrierlake.plans.clinical import OUT_SQL, outcomes
from carrierlake.plans.registry import bh_sql, normal_sql, query, rounded, student_sql

# Spellings of the sheets; an order takes the one that its keys pick.
SPELLED = {
    "msi": ["MSI", "msih", "MSI-H ", "mss", "Stable", "no loss", "n/a", "unstable"],
    "molecular": ["POLE mut", "dMMR", "NSMP", "no specific profile", "TP53 abn", "", "p53 / MMRd", "other"],
    "exitus": ["SI", "si: fallo", "No", "exitus", "0", "1", "null", "unknown"],
    "status": ["Viva sin enfermedad", "EXITUS 2019", "perdido de vista", "Paliativos", "fallecida", "recidiva local", "?", "NaN"],
    "recurrence": ["NO", "no pd", "PD", "yes pd", "pulmonar", "si", "none", "X"],
    "mets": ["SI", "m1", "Distant node", "NO-LOCAL", "M0", "local", "maybe", " "],
    "invasion": ["<50%", "> 50", ">50 %", "none seen", "<50", "NA", "n/a", "superficial"],
    "lvsi": ["YES", "no", " Yes ", "focal", "NO", "", "y", "nan"],
    "risk": ["low", "HIGH", "Intermediate", "intermediate-high", "very high", "N/A", "Low ", "High"],
    "dx": ["CDI HER2+", "her2 +", "TN", "triple negativo", "luminal A", "None", "HER2-", "CLI"],
    "grade": ["G1", "G2", "3", "x", "grado 2-3", "", "G 3", "G1/2"],
    "ki67": ["40", "40%", "0.4", "20-25%", "0.2-0.25", "alto", "1", "5 - 10"],
    "figo": ["IA", "IB", "i", "IIIC1", "IIIC2", "IVB", "x", "III"],
}
PICK = "(o_orderkey + 3 * o_custkey) % 8"


def spelled(t):
    place = F.expr(f"int({PICK})")
    return t.orders.select("o_orderkey", *[F.get(F.array(*[F.lit(x) for x in texts]), place).alias(f"raw_{name}") for name, texts in SPELLED.items()])


SPELLED_SQL = "WITH raw AS (SELECT o_orderkey, " + ", ".join(f"{texts!r}[1 + {PICK}] AS {name}" for name, texts in SPELLED.items()) + " FROM orders), up AS (SELECT o_orderkey, " + ", ".join(
    f"CASE WHEN lower(trim({name})) NOT IN ('', 'nan', 'none', 'null', 'n/a') THEN trim({name}) END AS {name}, CASE WHEN lower(trim({name})) NOT IN ('', 'nan', 'none', 'null', 'n/a') THEN upper(trim({name})) END AS u_{name}"
    for name in SPELLED
) + " FROM raw)"
# (output, source, patterns in order, categories; null keeps the text)
PATTERNS = [
    ("msi_status", "msi", ["^(MSS|STABLE|MS-STABLE)$", "^(MSI|MSI-H|UNSTABLE|MSI-HIGH|MSIH)$", ""], "['Stable', 'Unstable', NULL]"),
    ("molecular_class", "molecular", ["POLE", "MMR", "NSMP|NO SPECIFIC", "P53", ""], "['POLE', 'MMRd', 'NSMP', 'P53', NULL]"),
    ("exitus", "exitus", ["^(SI|YES|EXITUS|1)$", "^(NO|0)$", "^SI:", ""], "['Yes', 'No', 'Yes', NULL]"),
    ("vital_status", "status", ["SIN ENFERMEDAD|VIV[OA]", "EXITUS|FALLEC", "PERDIDO|SEGUIMIENTO", "PALIATIV|ECOG 4|RECIDIVA", ""], "['Alive_NED', 'Dead', 'Lost_FU', 'Alive_Disease', 'Other']"),
    ("recurrence", "recurrence", ["^NO( PD)?$", "^(PD|YES|YES PD)$", "^.{4,}", ""], "['No', 'Yes', 'Yes', NULL]"),
    ("distant_mets", "mets", ["^(SI|M1)$", "^DISTANT", "^(NO|NO-LOCAL|M0|LOCAL)$", ""], "['Yes', 'Yes', 'No', NULL]"),
    ("myometrial_invasion", "invasion", ["<50", ">50", ""], "['<50%', '>50%', NULL]"),
    ("lvsi", "lvsi", ["^YES$", "^NO$", ""], "['Yes', 'No', NULL]"),
    ("risk_group", "risk", ["^LOW$", "^INTERMEDIATE$", "^INTERMEDIATE-HIGH$", "^HIGH$", ""], "['Low', 'Intermediate', 'Intermediate-High', 'High', NULL]"),
    ("her2_subtype", "dx", ["HER2 ?\\+", "TN|TRIPLE", ""], "['HER2+', 'TN', 'Other']"),
]
PLACES_SQL = ", pl AS (SELECT *, " + ", ".join(
    "CASE " + " ".join(f"WHEN regexp_matches(u_{source}, '{p}') THEN {i}" for i, p in enumerate(patterns, 1)) + f" END AS canon__{output}__rule" for output, source, patterns, _ in PATTERNS
) + " FROM up), ca AS (SELECT *, " + ", ".join(
    f"coalesce({names}[canon__{output}__rule], CASE WHEN canon__{output}__rule IS NOT NULL THEN {source} END) AS canon__{output}" for output, source, _, names in PATTERNS
) + " FROM pl)"


def decided(t):
    return decisions.decide(spelled(t), decisions.CLINICAL_TABLE, {name: f"raw_{name}" for name in SPELLED})


@query(
    "clinical_decisions",
    SPELLED_SQL + PLACES_SQL + " SELECT o_orderkey, " + ", ".join(f"canon__{output}, canon__{output}__rule" for output, *_ in PATTERNS) + " FROM ca",
)
def _decisions(t):
    return decided(t).select("o_orderkey", *[c for output, *_ in PATTERNS for c in (f"canon__{output}", f"canon__{output}__rule")])


FLAGS = {"exitus": "exitus_flag", "recurrence": "recurrence_flag", "distant_mets": "distant_mets_flag", "lvsi": "lvsi_flag"}


@query(
    "clinical_codes",
    SPELLED_SQL + PLACES_SQL + " SELECT o_orderkey, " + ", ".join(f"CASE canon__{c} WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END::INT AS canon__{flag}" for c, flag in FLAGS.items()) + """,
      CASE canon__myometrial_invasion WHEN '>50%' THEN 1 WHEN '<50%' THEN 0 END::INT AS canon__invasion_flag, CASE canon__msi_status WHEN 'Unstable' THEN 1 WHEN 'Stable' THEN 0 END::INT AS canon__msi_flag,
      CASE canon__risk_group WHEN 'Low' THEN 1 WHEN 'Intermediate' THEN 2 WHEN 'Intermediate-High' THEN 3 WHEN 'High' THEN 4 END::INT AS canon__risk_ordinal,
      [1.0, 2.0, 3.0, NULL, 2.0, NULL, 3.0, 1.0][1 + (o_orderkey + 3 * o_custkey) % 8]::DOUBLE AS grade_number, [0.4, 0.4, 0.4, 0.225, 0.225, NULL, 1.0, 0.075][1 + (o_orderkey + 3 * o_custkey) % 8]::DOUBLE AS ki67_fraction,
      [1.0, 1.5, 1.5, 3.3, 3.4, 4.2, NULL, 3.0][1 + (o_orderkey + 3 * o_custkey) % 8]::DOUBLE AS figo_number FROM ca JOIN orders USING (o_orderkey)""",
)
def _codes(t):
    out = decisions.coded(decided(t))
    numbers = (rules.grade_number(F.col("raw_grade")).alias("grade_number"), rules.ki67_fraction(F.col("raw_ki67")).alias("ki67_fraction"), rules.ordinal(F.col("raw_figo"), rules.FIGO_LEVELS).alias("figo_number"))
    return rounded(out.select("o_orderkey", *[f"canon__{name}" for name in decisions.CODES], *numbers))


CHI_P = f"""CASE dof WHEN 1 THEN {normal_sql('sqrt(s)')} WHEN 2 THEN exp(-s / 2) WHEN 3 THEN {normal_sql('sqrt(s)')} + sqrt(2 * s / pi()) * exp(-s / 2)
  WHEN 6 THEN exp(-s / 2) * (1 + s / 2 + s * s / 8) END"""


@query(
    "haplotype_dose",
    OUT_SQL + f""", ex AS (SELECT DISTINCT variant FROM calls JOIN oc USING (sample)),
      dn AS (SELECT variant, sample, coalesce(dosage, 0) AS d, rich, zone, bal FROM ex CROSS JOIN oc LEFT JOIN calls USING (variant, sample)),
      sz AS (SELECT variant, count(*) FILTER (c >= 3) AS classes FROM (SELECT variant, d, count(*) AS c FROM dn GROUP BY 1, 2) GROUP BY 1),
      rk AS (SELECT variant, rank() OVER (PARTITION BY variant ORDER BY d) + (count(*) OVER (PARTITION BY variant, d) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY variant ORDER BY bal) + (count(*) OVER (PARTITION BY variant, bal) - 1) / 2.0 AS ry FROM dn),
      sp AS (SELECT variant, count(*) AS n, corr(rx, ry) AS s FROM rk JOIN sz USING (variant) WHERE classes >= 2 GROUP BY 1 HAVING count(*) >= 4),
      ce AS (SELECT variant, 'rich' AS var, 'binary' AS type, rich AS v, d, count(*)::DOUBLE AS o FROM dn GROUP BY ALL UNION ALL SELECT variant, 'zone', 'nominal', zone, d, count(*)::DOUBLE FROM dn GROUP BY ALL),
      bg AS (SELECT *, sum(o) OVER (PARTITION BY variant, var, d) AS r FROM ce QUALIFY r >= 3),
      mg AS (SELECT *, sum(o) OVER (PARTITION BY variant, var, v) AS c, sum(o) OVER (PARTITION BY variant, var) AS t FROM bg),
      cq AS (SELECT variant, var, type, any_value(t)::BIGINT AS n, any_value(t) * (sum(o * o / (r * c)) - 1) AS s, (count(DISTINCT d) - 1) * (count(DISTINCT v) - 1) AS dof FROM mg GROUP BY 1, 2, 3),
      tests AS (SELECT variant, 'bal' AS var, 'continuous' AS type, n, s AS statistic, {student_sql('s * sqrt((n - 2) / (1 - s * s))', '(n - 2)')} AS p FROM sp WHERE s IS NOT NULL
        UNION ALL SELECT variant, var, type, n, s, {CHI_P} FROM cq WHERE dof > 0), adj AS ({bh_sql('tests', 'p', 'type', 'q')})
    SELECT variant, var, type, n, round(statistic, 6) AS statistic, round(p, 6) AS p_value, round(q, 6) AS fdr FROM adj""",
)
def _haplotype_dose(t):
    return rounded(harmonise.haplotype_dose(t.calls(), outcomes(t), "variant"))
