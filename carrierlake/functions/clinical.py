"""Rules that turn messy clinical text into typed values; every rule is one expression."""

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from carrierlake.functions.keys import null_if_token

# Accented letters and their plain forms, position by position.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÑÇ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncAAAAAAEEEEIIIIOOOOOUUUUNC"

# Accepted spellings of yes and no, after accents are dropped and case is folded.
YES_WORDS = ["true", "t", "si", "s", "yes", "y", "positivo", "positiva", "pos", "+", "positive"]
NO_WORDS = ["false", "f", "no", "n", "negativo", "negativa", "neg", "-", "negative"]

# Keyword patterns per treatment family.
TREATMENT_PATTERNS = {
    "chemotherapy": r"\bac\b|\bfec\b|\bcmf\b|taxol|paclitaxel|docetaxel|cbdca|carbo|quimio|chemo|\bqt\b",
    "anti_her2": r"hercept|trastu|lapat|pertu|anti[\s-]?her[\s-]?2",
    "endocrine": r"tamox|letroz|exemest|anastro|arimid|fulves|hormon|terapia hormonal|\bht\b",
    "radiotherapy": r"\brt\b|radiot|radioter|rte|rdt",
}

NUMBER = r"([0-9]+(?:\.[0-9]+)?)"


def clean_text(c: Column) -> Column:
    """Repair doubly encoded text, turn no-break spaces into spaces, trim."""
    text = c.cast("string")
    broken = text.contains("Ã") | text.contains("Â")
    repaired = F.decode(F.encode(text, "ISO-8859-1"), "UTF-8")
    only_latin = ~text.rlike("[^\\x00-\\xFF]")
    return F.trim(F.translate(F.when(broken & only_latin, repaired).otherwise(text), "\u00a0", " "))


def strip_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def meaningful(c: Column) -> Column:
    """Cleaned text, null for the placeholder words."""
    return null_if_token(clean_text(c), ["", "nan", "none", "null", "n/a"])


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _group(text: Column, pattern: str, index: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit("")).try_cast("double")


def _upper_numeric(c: Column) -> Column:
    return F.translate(F.upper(clean_text(c)), ",?", ".-")


def yes_no(c: Column) -> Column:
    s = strip_accents(F.lower(clean_text(c)))
    value = F.when(s.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), s.try_cast("double"))
    return (
        F.when((value == 1) | s.isin(YES_WORDS), "Yes").when((value == 0) | s.isin(NO_WORDS), "No")
    )


def first_number(c: Column) -> Column:
    return _group(F.translate(clean_text(c), ",", "."), NUMBER)


def _within(value: Column, low: float, high: float, digits: int = 2) -> Column:
    return F.when(value.between(low, high), F.round(value, digits))


def weight_kg(c: Column) -> Column:
    return _within(_group(_upper_numeric(c), NUMBER + r"\s*KG\b"), 25.0, 250.0)


def height_cm(c: Column) -> Column:
    return _within(_group(_upper_numeric(c), NUMBER + r"\s*CM\b"), 120.0, 230.0)


def bmi(c: Column) -> Column:
    """Index between 10 and 70, computed from kg and cm when both are given."""
    return bind(_upper_numeric(c), _bmi_of)


def _bmi_of(s: Column) -> Column:
    fields = F.struct(
        _group(s, NUMBER + r"\s*KG\b").alias("kg"), _group(s, NUMBER + r"\s*CM\b").alias("cm"), _group(s, NUMBER).alias("first"),
        (s.contains("KG") & ~s.contains("CM")).alias("weight_only"),
    )

    def pick(r: Column) -> Column:
        both = r["kg"].between(25.0, 250.0) & r["cm"].between(120.0, 230.0)
        computed = F.try_divide(r["kg"], F.pow(r["cm"] / 100.0, F.lit(2.0)))
        return bind(F.when(both, computed).when(~r["weight_only"], r["first"]), lambda v: _within(v, 10.0, 70.0))

    return bind(fields, pick)


def bmi_category(c: Column) -> Column:
    """Class named in the text, else the class of the parsed index."""

    def pick(s: Column) -> Column:
        return (
            F.when(s.isin("", "X", "NA", "N/A", "NR", "NULL"), F.lit(None))
            .when(s.contains("SOBREPESO") | s.contains("OVERWEIGHT"), "Overweight")
            .when(s.contains("OBESIDAD") | s.contains("OBESE"), "Obese")
            .when(s.contains("BAJO PESO") | s.contains("UNDERWEIGHT"), "Underweight")
            .otherwise(bind(_bmi_of(s), lambda v: bmi_class(v, lower=None)))
        )

    return bind(_upper_numeric(c), pick)


def bmi_class(value: Column, lower: float | None = 20.0) -> Column:
    """Class on cut points 25 and 30; below ``lower`` null, or Underweight under 18.5 without it."""
    under = (
        F.when(value < 18.5, "Underweight") if lower is None else F.when(value < lower, F.lit(None).cast("string"))
    )
    return under.when(value < 25.0, "Normal").when(value < 30.0, "Overweight").when(value >= 30.0, "Obese")


def serial_date_percent(c: Column) -> Column:
    """Small integers that a spreadsheet turned into dates of 1899 or 1900."""
    s = clean_text(c)
    day = F.coalesce(
        F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_date(F.substring(s, 1, 10), "yyyy-MM-dd")),
        F.when(
            s.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}"),
            F.try_to_date(F.regexp_extract(s, r"^([0-9/]+)", 1), "M/d/yyyy"),
        ),
    )
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("double")
    return F.when(F.year(day).isin(1899, 1900) & serial.between(0.0, 100.0), serial)


def numeric_midpoint(c: Column) -> Column:
    """Recovered serial, midpoint of a range, bound of an inequality, else the first number."""
    s = _upper_numeric(c)
    span = NUMBER + r"\s*-\s*" + NUMBER
    return F.coalesce(
        serial_date_percent(c), (_group(s, span, 1) + _group(s, span, 2)) / 2.0, _group(s, NUMBER)
    )


def ki67_percent(c: Column, scale: str = "auto") -> Column:
    """Percentage 0-100. ``fraction`` also scales exactly 1.0, ``percent`` never scales."""
    scaled = {
        "fraction": lambda v: F.when(v <= 1.0, v * 100.0).otherwise(v),
        "percent": lambda v: v,
        "auto": lambda v: F.when(v < 1.0, v * 100.0).otherwise(v),
    }[scale]
    blank = F.upper(clean_text(c)).isin("", "X", "N/A", "ND", "NOT DONE", "PENDING")
    value = bind(numeric_midpoint(c), scaled)
    return F.when(~blank, bind(value, lambda v: _within(v, 0.0, 100.0, 1)))


def _contains_any(s: Column, words: list[str]) -> Column:
    flag = F.lit(False)
    for word in words:
        flag = flag | s.contains(word)
    return flag


def _text_and_value(c: Column) -> Column:
    return F.struct(F.upper(clean_text(c)).alias("s"), numeric_midpoint(c).alias("v"))


def receptor(c: Column) -> Column:
    """Struct ``(value, status)``; positive from 1 percent upwards."""

    def pick(r: Column) -> Column:
        s, value = r["s"], r["v"]
        blank = s.isNull() | s.isin("", "N/A", "ND", "NOT DONE")
        negative = s.contains("NEG") & ~s.contains("POS")
        positive = _contains_any(s, ["POSITIVE", "POSITIVO", "FOCAL"])
        status = (
            F.when(blank, F.lit(None).cast("string"))
            .when(negative, "Negative")
            .when(positive, "Positive")
            .when(value.between(0.0, 100.0), F.when(value >= 1.0, "Positive").otherwise("Negative"))
        )
        kept = (
            F.when(blank, F.lit(None).cast("double"))
            .when(negative, 0.0)
            .when(positive | value.between(0.0, 100.0), value)
        )
        return F.struct(kept.alias("value"), status.alias("status"))

    return bind(_text_and_value(c), pick)


def p53(c: Column) -> Column:
    """Struct ``(value, status)``; aberrant from 10 percent upwards."""
    aberrant = ["POSITIVE", "OVEREXPRESS", "OVER-EXPRESS", "HIGH", "ABERRANT", "MUT", "LOST", "NULL", "ABSENT"]

    def pick(r: Column) -> Column:
        s, value = r["s"], r["v"]
        blank = s.isNull() | s.isin("", "N/A", "ND", "NOT DONE")
        status = (
            F.when(blank, F.lit(None).cast("string"))
            .when(_contains_any(s, ["WT", "WILD TYPE", "WILD-TYPE", "NORMAL"]), "Normal")
            .when(_contains_any(s, aberrant), "Aberrant")
            .when(value >= F.when(value > 1.0, 10.0).otherwise(0.10), "Aberrant")
            .when(value.isNotNull(), "Normal")
        )
        return F.struct(F.when(~blank, value).alias("value"), status.alias("status"))

    return bind(_text_and_value(c), pick)


def grade(c: Column) -> Column:
    """Grade 1-4 from ``G3``, ``GRADO 2`` or ``2``."""
    s = F.upper(clean_text(c))
    return F.coalesce(_group(s, r"\b([1-4])\b"), _group(s, r"\bG([1-4])\b")).cast("int")


def figo_stage(c: Column) -> Column:
    """Compact stage such as IA or IIIC1; arabic leading digits become roman."""
    s = F.regexp_replace(F.upper(clean_text(c)), r"FIGO|STAGE|ESTADIO|[ -]", "")
    roman = F.regexp_extract(s, r"^(I{1,3}|IV)([A-C]?[0-9]?)$", 0)
    digit = F.regexp_extract(s, r"^([1-4])([A-C]?[0-9]?)$", 1)
    numeral = F.get(F.array(*[F.lit(x) for x in ("", "I", "II", "III", "IV")]), digit.try_cast("int"))
    return F.coalesce(
        F.when(digit != "", F.concat(numeral, F.regexp_extract(s, r"^([1-4])([A-C]?[0-9]?)$", 2))),
        F.nullif(roman, F.lit("")),
    )


def parse_date(c: Column) -> Column:
    """Spreadsheet serials, ISO, slashed, dashed, packed and worded dates; day first unless that cannot be."""
    s = clean_text(c)
    head = F.regexp_extract(s, r"^([0-9/-]+)", 1)
    clock = r"([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2})?)?$"
    first, second = _group(s, r"^([0-9]{1,2})/"), _group(s, r"^[0-9]{1,2}/([0-9]{1,2})/")
    # day, first three letters of an English month, year: "5 Mar 2020", "05-march-2020"
    worded = F.regexp_replace(F.regexp_extract(s, r"^([0-9]{1,2}[ -][A-Za-z]{3,9}[ ,-]+[0-9]{4})$", 1), r"^([0-9]+)[ -]([A-Za-z]{3})[A-Za-z]*[ ,-]+", "$1 $2 ")
    serial = F.when(s.rlike(r"^[0-9]{1,5}(\.[0-9]+)?$"), s.try_cast("double"))
    slashed = s.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}" + clock)
    return (
        F.when(serial.between(1, 60000), F.date_add(F.lit("1899-12-30").cast("date"), F.floor(serial).cast("int")))
        .when(s.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}" + clock), F.try_to_date(head, "yyyy-M-d"))
        .when(slashed & (second > 12) & (first <= 12), F.try_to_date(head, "M/d/yyyy"))
        .when(slashed, F.try_to_date(head, "d/M/yyyy"))
        .when(s.rlike(r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}" + clock), F.try_to_date(head, "d-M-yyyy"))
        .when(s.rlike(r"^[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}" + clock), F.try_to_date(head, "yyyy/M/d"))
        .when(s.rlike(r"^(19|20)[0-9]{6}$"), F.try_to_date(s, "yyyyMMdd"))
        .when(worded != "", F.try_to_date(F.initcap(worded), "d MMM yyyy"))
    )


def treatment_flags(c: Column) -> Column:
    """Struct of Yes/No exposure flags, all null for placeholder text."""
    s = F.regexp_replace(strip_accents(F.lower(clean_text(c))), r"\s+", " ")
    blank = s.isNull() | s.isin("", "x", "na", "n/a", "none", "no consta")
    return F.struct(
        *[
            F.when(~blank, F.when(s.rlike(pattern), "Yes").otherwise("No")).alias(name)
            for name, pattern in TREATMENT_PATTERNS.items()
        ]
    )


def tumour_volume(c: Column) -> Column:
    """Product of up to three dimensions written as ``a x b x c``."""
    s = F.lower(F.translate(clean_text(c), ",×", ".x"))
    numbers = F.transform(
        F.regexp_extract_all(s, F.lit(r"([0-9]+(?:\.[0-9]+)?)"), 1), lambda x: x.try_cast("double")
    )
    return F.when(
        s.contains("x") & (F.size(numbers) >= 2),
        F.round(F.aggregate(F.slice(numbers, 1, 3), F.lit(1.0), lambda acc, x: acc * x), 3),
    )


def months_between_dates(start: Column, end: Column) -> Column:
    """Days / 30.44, kept only strictly between 0 and 600 months."""
    months = F.datediff(end, start) / F.lit(30.44)
    return F.when((months > 0) & (months < 600), months)


def grade_number(c: Column) -> Column:
    """First digit of a grade text such as ``G2``."""
    return _group(c.cast("string"), "([0-9])")


def ki67_fraction(c: Column) -> Column:
    """Share between 0 and 1 from a number or the middle of a range; values above 1 are per cent."""
    s = F.trim(F.translate(clean_text(c), "%", ""))
    low, high = (_group(s, r"^([0-9.]+)\s*[-\u2013]\s*([0-9.]+)", i) for i in (1, 2))
    single = F.when(s.rlike(r"^[0-9]*\.?[0-9]+$"), s.try_cast("double"))
    value = F.coalesce((low + high) / 2.0, single)
    return F.when(value > 1, value / 100.0).otherwise(value)


def ordinal(c: Column, levels: dict[str, float]) -> Column:
    """Rank of a category from a level map, null when unknown."""
    table = F.create_map(*[x for k, v in levels.items() for x in (F.lit(k), F.lit(float(v)))])
    return F.try_element_at(table, F.upper(F.trim(c.cast("string"))))


# Ordered categories.
FIGO_LEVELS = {
    "IA": 1.0, "IB": 1.5, "I": 1.5, "II": 2.0,
    "IIIA": 3.1, "IIIB": 3.2, "IIIC1": 3.3, "IIIC2": 3.4, "III": 3.0, "IVA": 4.1, "IVB": 4.2, "IV": 4.0,
}
RISK_LEVELS = {"LOW": 1, "INTERMEDIATE": 2, "INTERMEDIATE-HIGH": 3, "HIGH": 4}
YES_NO_LEVELS = {"NO": 0, "YES": 1}
