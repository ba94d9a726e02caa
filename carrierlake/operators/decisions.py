"""Clinical categories from a decision table: rows of (output, source, test, words, result), compiled to two staged projections."""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from carrierlake.functions.clinical import meaningful

KEEP = object()  # result of a row that leaves the cleaned text as it stands


class Row(NamedTuple):
    output: str
    source: str
    test: str  # is, has, starts, longer, any
    words: tuple
    result: object


def _table(output: str, source: str, *rows: tuple) -> list[Row]:
    return [Row(output, source, test, words, result) for test, words, result in rows]


# Spellings and categories of the clinical sheets, tried in this order (upper case, trimmed).
CLINICAL_TABLE = [
    *_table(
        "msi_status", "msi",
        ("is", ("MSS", "STABLE", "MS-STABLE"), "Stable"), ("is", ("MSI", "MSI-H", "UNSTABLE", "MSI-HIGH", "MSIH"), "Unstable"), ("any", (), KEEP),
    ),
    *_table(
        "molecular_class", "molecular",
        ("has", ("POLE",), "POLE"), ("has", ("MMR",), "MMRd"), ("has", ("NSMP", "NO SPECIFIC"), "NSMP"), ("has", ("P53",), "P53"), ("any", (), KEEP),
    ),
    *_table("exitus", "exitus", ("is", ("SI", "YES", "EXITUS", "1"), "Yes"), ("is", ("NO", "0"), "No"), ("starts", ("SI:",), "Yes"), ("any", (), KEEP)),
    *_table(
        "vital_status", "status",
        ("has", ("SIN ENFERMEDAD", "VIVO", "VIVA"), "Alive_NED"), ("has", ("EXITUS", "FALLEC"), "Dead"), ("has", ("PERDIDO", "SEGUIMIENTO"), "Lost_FU"),
        ("has", ("PALIATIV", "ECOG 4", "RECIDIVA"), "Alive_Disease"), ("any", (), "Other"),
    ),
    *_table("recurrence", "recurrence", ("is", ("NO", "NO PD"), "No"), ("is", ("PD", "YES", "YES PD"), "Yes"), ("longer", (3,), "Yes"), ("any", (), KEEP)),
    *_table("distant_mets", "mets", ("is", ("SI", "M1"), "Yes"), ("starts", ("DISTANT",), "Yes"), ("is", ("NO", "NO-LOCAL", "M0", "LOCAL"), "No"), ("any", (), KEEP)),
    *_table("myometrial_invasion", "invasion", ("has", ("<50",), "<50%"), ("has", (">50",), ">50%"), ("any", (), KEEP)),
    *_table("lvsi", "lvsi", ("is", ("YES",), "Yes"), ("is", ("NO",), "No"), ("any", (), KEEP)),
    *_table(
        "risk_group", "risk",
        ("is", ("LOW",), "Low"), ("is", ("INTERMEDIATE",), "Intermediate"), ("is", ("INTERMEDIATE-HIGH",), "Intermediate-High"), ("is", ("HIGH",), "High"), ("any", (), KEEP),
    ),
    *_table("her2_subtype", "dx", ("has", ("HER2+", "HER2 +"), "HER2+"), ("has", ("TN", "TRIPLE"), "TN"), ("any", (), "Other")),
]

# Outcome codes of the categories above.
CODES = {
    "exitus_flag": ("exitus", {"Yes": 1, "No": 0}),
    "recurrence_flag": ("recurrence", {"Yes": 1, "No": 0}),
    "distant_mets_flag": ("distant_mets", {"Yes": 1, "No": 0}),
    "lvsi_flag": ("lvsi", {"Yes": 1, "No": 0}),
    "invasion_flag": ("myometrial_invasion", {">50%": 1, "<50%": 0}),
    "msi_flag": ("msi_status", {"Unstable": 1, "Stable": 0}),
    "risk_ordinal": ("risk_group", {"Low": 1, "Intermediate": 2, "Intermediate-High": 3, "High": 4}),
}


def _holds(row: Row, upper: Column) -> Column:
    some = lambda one: F.exists(F.array(*[F.lit(w) for w in row.words]), one) if len(row.words) > 1 else one(F.lit(row.words[0]))
    if row.test == "is":
        return upper.isin(*row.words)
    if row.test == "has":
        return some(lambda w: F.contains(upper, w))
    if row.test == "starts":
        return some(lambda w: F.startswith(upper, w))
    if row.test == "longer":
        return F.length(upper) > row.words[0]
    if row.test == "any":
        return upper.isNotNull()
    raise ValueError(f"unknown test {row.test!r}")


def decide(df: DataFrame, table: list[Row], sources: dict[str, str]) -> DataFrame:
    """Add ``canon__<output>`` and ``canon__<output>__rule`` (place of the row that decided, from 1) for every output of the table.

    ``sources`` gives the column of each source of the table; outputs whose source is not given are left out, so one table serves
    sheets with drift. Blank, placeholder and null texts decide nothing: both columns are null. The first row that holds decides.
    Each source is cleaned once, in a projection of its own; the next one finds the deciding row, the last one looks its result up.
    """
    used = [r for r in table if r.source in sources]
    names = list(dict.fromkeys(r.source for r in used))
    outputs = list(dict.fromkeys(r.output for r in used))
    staged = df.select("*", *[meaningful(F.col(sources[s])).alias(f"_text_{s}") for s in names])
    staged = staged.select("*", *[F.upper(f"_text_{s}").alias(f"_upper_{s}") for s in names])
    rules, values = [], []
    for output in outputs:
        rows = [r for r in used if r.output == output]
        place = None
        for i, row in enumerate(rows, 1):
            test = _holds(row, F.col(f"_upper_{row.source}"))
            place = F.when(test, i) if place is None else place.when(test, i)
        rules.append(place.alias(f"canon__{output}__rule"))
        result = F.get(F.array(*[F.lit(None if r.result is KEEP else r.result).cast("string") for r in rows]), F.col(f"canon__{output}__rule") - 1)
        kept = any(r.result is KEEP for r in rows)
        text = F.when(F.col(f"canon__{output}__rule").isNotNull(), F.col(f"_text_{rows[0].source}"))
        values.append((F.coalesce(result, text) if kept else result).alias(f"canon__{output}"))
    staged = staged.select("*", *rules)
    return staged.select("*", *values).drop(*[f"_text_{s}" for s in names], *[f"_upper_{s}" for s in names])


def coded(df: DataFrame, codes: dict[str, tuple[str, dict[str, int]]] = CODES) -> DataFrame:
    """Add the integer code of each category that the table holds; other texts have none."""
    known = {name: pair for name, pair in codes.items() if f"canon__{pair[0]}" in df.columns}

    def code(output: str, levels: dict[str, int]) -> Column:
        table = F.create_map(*[x for k, v in levels.items() for x in (F.lit(k), F.lit(v))])
        return F.try_element_at(table, F.col(f"canon__{output}"))

    return df.select("*", *[code(*pair).alias(f"canon__{name}") for name, pair in known.items()])
