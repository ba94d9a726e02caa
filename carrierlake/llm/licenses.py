r"""License scans by ordered signature rules.

A text becomes its words, joined by single spaces. Rules are regexes over that form, each gated by one keyword, so a text is only matched
against the rules whose keyword it holds. Detections overlap; one that lies inside another of at least its priority is suppressed. The
rules are a literal array in the expression: no join, no shuffle, no Python.
"""

from pyspark.sql import Column, DataFrame, functions as F

from .common import ascii_lower, documents, query, text_of

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases with their labels. Their detections are never suppressed.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

VERSION = r"(?:version |v)?"

#: Label, gate keyword, and signatures over space-joined lower-case words; punctuation is gone, so "2.0" reads "2 0". The keyword is a word of
#: every wording that a signature matches; without it the signature is not tried.
SIGNATURES = [
    ("mit", "mit", ["(?:the )?mit licen[cs]e", "mit licensed", "licen[cs]ed? under (?:the )?mit", "spdx license identifier mit", "opensource org licenses mit(?: license(?: php)?)?"]),
    ("mit", "permission", ["permission is hereby granted free of charge to any person obtaining a copy", "the above copyright notice and this permission notice shall be included in all copies"]),
    ("mit-0", "mit", ["mit no attribution", "mit 0 licen[cs]e", "spdx license identifier mit 0"]),
    ("x11", "x11", ["x11 licen[cs]e", "licen[cs]ed under (?:the )?x11", "spdx license identifier x11"]),
    ("apache", "apache", ["(?:the )?apache licen[cs]e", "apache software licen[cs]e", "apache org licenses license 2 0(?: txt| html)?"]),
    ("apache-2.0", "apache", ["apache licen[cs]e " + VERSION + "2 0", "apache 2 0", "spdx license identifier apache 2 0", "licen[cs]ed under (?:the )?apache " + VERSION + "2(?: 0)?"]),
    ("apache-2.0", "apache2", ["apache2 licen[cs]ed?"]),
    ("apache-1.1", "apache", ["apache (?:software )?licen[cs]e " + VERSION + "1 1", "spdx license identifier apache 1 1"]),
    ("apache-1.0", "apache", ["apache (?:software )?licen[cs]e " + VERSION + "1 0", "spdx license identifier apache 1 0"]),
    ("gpl", "general", ["gnu general public licen[cs]e", "general public licen[cs]e", "general public licen[cs]e as published by the free software foundation"]),
    ("gpl-1.0", "gpl", ["gpl " + VERSION + "1(?: 0)?", "spdx license identifier gpl 1 0(?: only| or later)?"]),
    ("gpl-1.0", "gplv1", ["gplv1"]),
    ("gpl-2.0", "general", ["(?:gnu )?general public licen[cs]e " + VERSION + "2(?: 0)?"]),
    ("gpl-2.0", "either", ["either version 2 of the (?:gnu )?(?:general public )?licen[cs]e"]),
    ("gpl-2.0", "gplv2", ["gplv2(?: only| or later)?"]),
    ("gpl-2.0", "gpl", ["gpl " + VERSION + "2(?: 0)?", "spdx license identifier gpl 2 0(?: only| or later)?", "gnu org licenses (?:old licenses )?gpl 2 0(?: html| txt)?"]),
    ("gpl-3.0", "general", ["(?:gnu )?general public licen[cs]e " + VERSION + "3(?: 0)?"]),
    ("gpl-3.0", "either", ["either version 3 of the (?:gnu )?(?:general public )?licen[cs]e"]),
    ("gpl-3.0", "gplv3", ["gplv3(?: only| or later)?"]),
    ("gpl-3.0", "gpl", ["gpl " + VERSION + "3(?: 0)?", "spdx license identifier gpl 3 0(?: only| or later)?", "gnu org licenses gpl 3 0(?: html| txt)?"]),
    ("lgpl", "lesser", ["(?:gnu )?lesser general public licen[cs]e", "gnu lesser gpl"]),
    ("lgpl", "lgpl", ["(?:gnu )?lgpl", "licen[cs]ed under (?:the )?(?:gnu )?lgpl"]),
    ("lgpl-2.0", "library", ["(?:gnu )?library general public licen[cs]e(?: " + VERSION + "2(?: 0)?)?"]),
    ("lgpl-2.0", "lgpl", ["spdx license identifier lgpl 2 0(?: only| or later)?"]),
    ("lgpl-2.1", "lesser", ["lesser general public licen[cs]e " + VERSION + "2 1"]),
    ("lgpl-2.1", "lgpl", ["lgpl " + VERSION + "2 1", "spdx license identifier lgpl 2 1(?: only| or later)?"]),
    ("lgpl-3.0", "lesser", ["lesser general public licen[cs]e " + VERSION + "3(?: 0)?"]),
    ("lgpl-3.0", "lgpl", ["lgpl " + VERSION + "3(?: 0)?", "spdx license identifier lgpl 3 0(?: only| or later)?"]),
    ("agpl-3.0", "affero", ["(?:gnu )?affero general public licen[cs]e(?: " + VERSION + "3(?: 0)?)?"]),
    ("agpl-3.0", "agpl", ["(?:gnu )?agpl(?: " + VERSION + "3(?: 0)?)?", "spdx license identifier agpl 3 0(?: only| or later)?"]),
    ("agpl-3.0", "agplv3", ["agplv3(?: only| or later)?"]),
    ("gfdl", "documentation", ["(?:gnu )?free documentation licen[cs]e(?: " + VERSION + "1 [123])?"]),
    ("gfdl", "gfdl", ["spdx license identifier gfdl 1 [123](?: only| or later)?"]),
    ("bsd", "bsd", ["(?:the )?bsd licen[cs]e", "bsd style licen[cs]e", "licen[cs]ed under (?:the )?bsd", "bsd licensed", "opensource org licenses bsd license(?: php)?"]),
    ("bsd-2-clause", "bsd", ["bsd 2 clause(?: simplified)?(?: licen[cs]e)?", "2 clause bsd(?: licen[cs]e)?", "simplified bsd licen[cs]e", "spdx license identifier bsd 2 clause"]),
    ("bsd-2-clause", "freebsd", ["freebsd licen[cs]e"]),
    ("bsd-3-clause", "bsd", ["bsd 3 clause(?: new| revised)?(?: licen[cs]e)?", "3 clause bsd(?: licen[cs]e)?", "(?:new|revised|modified) bsd licen[cs]e", "spdx license identifier bsd 3 clause"]),
    ("bsd-4-clause", "bsd", ["bsd 4 clause(?: licen[cs]e)?", "4 clause bsd(?: licen[cs]e)?", "original bsd licen[cs]e", "spdx license identifier bsd 4 clause"]),
    ("0bsd", "0bsd", ["0bsd(?: licen[cs]e)?", "spdx license identifier 0bsd"]),
    ("0bsd", "zero", ["zero clause bsd(?: licen[cs]e)?"]),
    ("bsd-3-clause", "redistributions", ["redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice"]),
    ("isc", "isc", ["(?:the )?isc licen[cs]e", "licen[cs]ed under (?:the )?isc", "spdx license identifier isc", "opensource org licenses isc(?: license)?"]),
    ("isc", "permission", ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"]),
    ("mpl-1.1", "mozilla", ["mozilla public licen[cs]e " + VERSION + "1 1"]),
    ("mpl-2.0", "mozilla", ["mozilla public licen[cs]e(?: " + VERSION + "2(?: 0)?)?", "mozilla org mpl 2 0"]),
    ("mpl-2.0", "mpl", ["mpl " + VERSION + "2(?: 0)?", "spdx license identifier mpl 2 0", "licen[cs]ed under (?:the )?mpl"]),
    ("epl-1.0", "eclipse", ["eclipse public licen[cs]e(?: " + VERSION + "1(?: 0)?)?", "eclipse org legal epl v10(?: html)?"]),
    ("epl-2.0", "eclipse", ["eclipse public licen[cs]e " + VERSION + "2(?: 0)?", "eclipse org legal epl 2 0"]),
    ("epl-2.0", "epl", ["epl " + VERSION + "2(?: 0)?", "spdx license identifier epl 2 0"]),
    ("edl-1.0", "eclipse", ["eclipse distribution licen[cs]e(?: " + VERSION + "1(?: 0)?)?"]),
    ("cddl-1.0", "cddl", ["cddl(?: " + VERSION + "1(?: 0)?)?", "spdx license identifier cddl 1 0"]),
    ("cddl-1.1", "cddl", ["cddl " + VERSION + "1 1", "spdx license identifier cddl 1 1"]),
    ("cddl-1.0", "common", ["common development and distribution licen[cs]e(?: " + VERSION + "1 [01])?"]),
    ("cpl-1.0", "common", ["common public licen[cs]e(?: " + VERSION + "1(?: 0)?)?"]),
    ("cpal-1.0", "common", ["common public attribution licen[cs]e(?: " + VERSION + "1(?: 0)?)?"]),
    ("ibm-pl", "ibm", ["ibm public licen[cs]e(?: " + VERSION + "1(?: 0)?)?"]),
    ("artistic-1.0", "artistic", ["artistic licen[cs]e(?: " + VERSION + "1(?: 0)?)?", "spdx license identifier artistic 1 0"]),
    ("artistic-2.0", "artistic", ["artistic licen[cs]e " + VERSION + "2(?: 0)?", "spdx license identifier artistic 2 0"]),
    ("zlib", "zlib", ["zlib licen[cs]e", "zlib libpng licen[cs]e", "spdx license identifier zlib", "licen[cs]ed under (?:the )?zlib"]),
    ("libpng", "libpng", ["libpng licen[cs]e(?: " + VERSION + "2)?", "spdx license identifier libpng(?: 2 0)?"]),
    ("boost", "boost", ["boost software licen[cs]e(?: " + VERSION + "1(?: 0)?)?", "boost org license 1 0(?: txt)?"]),
    ("boost", "bsl", ["spdx license identifier bsl 1 0"]),
    ("unlicense", "unlicense", ["the unlicense", "unlicense org", "spdx license identifier unlicense"]),
    ("unlicense", "unencumbered", ["free and unencumbered software released into the public domain"]),
    ("wtfpl", "wtfpl", ["wtfpl(?: licen[cs]e)?(?: " + VERSION + "2)?", "spdx license identifier wtfpl"]),
    ("public-domain", "domain", ["(?:released|placed|dedicated) (?:in|into|to) the public domain", "public domain dedication", "public domain licen[cs]e"]),
    ("cc0-1.0", "cc0", ["cc0(?: " + VERSION + "1(?: 0)?)?(?: universal)?", "spdx license identifier cc0 1 0"]),
    ("cc0-1.0", "commons", ["creative commons (?:zero|cc0)"]),
    ("cc-by-4.0", "commons", ["creative commons attribution (?:licen[cs]e )?4 0(?: international)?"]),
    ("cc-by-4.0", "creativecommons", ["creativecommons org licenses by 4 0"]),
    ("cc-by-3.0", "commons", ["creative commons attribution (?:licen[cs]e )?3 0(?: unported)?"]),
    ("cc-by", "commons", ["creative commons attribution(?: licen[cs]e)?(?: [1234] [05])?(?: international| unported| generic)?"]),
    ("cc-by-sa", "sharealike", ["(?:creative commons )?attribution sharealike(?: [1234] [05])?(?: international| unported)?"]),
    ("cc-by-sa", "alike", ["(?:creative commons )?attribution share alike(?: [1234] [05])?(?: international| unported)?"]),
    ("cc-by-nc", "noncommercial", ["(?:creative commons )?attribution noncommercial(?: [1234] [05])?(?: international| unported)?"]),
    ("cc-by-nc-sa", "noncommercial", ["(?:creative commons )?attribution noncommercial share ?alike(?: [1234] [05])?"]),
    ("cc-by-nd", "attribution", ["(?:creative commons )?attribution no ?deriv(?:ative)?s(?: [1234] [05])?"]),
    ("cc-by", "cc", ["cc by(?: [1234] [05])?", "spdx license identifier cc by [1234] [05]"]),
    ("cc-by-sa", "cc", ["cc by sa(?: [1234] [05])?", "spdx license identifier cc by sa [1234] [05]"]),
    ("cc-by-nc", "cc", ["cc by nc(?: [1234] [05])?", "spdx license identifier cc by nc [1234] [05]"]),
    ("cc-by-nc-sa", "cc", ["cc by nc sa(?: [1234] [05])?", "spdx license identifier cc by nc sa [1234] [05]"]),
    ("cc-by-nc-nd", "cc", ["cc by nc nd(?: [1234] [05])?", "spdx license identifier cc by nc nd [1234] [05]"]),
    ("cc-by-nd", "cc", ["cc by nd(?: [1234] [05])?", "spdx license identifier cc by nd [1234] [05]"]),
    ("eupl", "eupl", ["eupl(?: " + VERSION + "1 [012])?", "spdx license identifier eupl 1 [12]"]),
    ("eupl", "union", ["european union public licen[cs]e(?: " + VERSION + "1 [012])?"]),
    ("cecill", "cecill", ["cecill(?: free software licen[cs]e)?(?: " + VERSION + "[12](?: [01])?)?", "cecill [bc]", "spdx license identifier cecill(?: 2 1)?"]),
    ("ofl-1.1", "sil", ["sil open font licen[cs]e(?: " + VERSION + "1 1)?", "scripts sil org ofl"]),
    ("ofl-1.1", "ofl", ["ofl " + VERSION + "1 1", "spdx license identifier ofl 1 1"]),
    ("postgresql", "postgresql", ["postgresql licen[cs]e", "spdx license identifier postgresql"]),
    ("python", "python", ["python software foundation licen[cs]e(?: " + VERSION + "2(?: 0)?)?"]),
    ("python", "identifier", ["spdx license identifier (?:python|psf) 2 0"]),
    ("python", "psf", ["psf licen[cs]e"]),
    ("php", "php", ["php licen[cs]e(?: " + VERSION + "3(?: 0[01]?)?)?", "spdx license identifier php 3 01?"]),
    ("ruby", "ruby", ["ruby licen[cs]e", "(?:same|licensed under the) terms as ruby", "spdx license identifier ruby"]),
    ("perl", "perl", ["same terms as perl(?: itself)?", "perl licen[cs]e"]),
    ("openssl", "openssl", ["openssl licen[cs]e", "openssl toolkit", "spdx license identifier openssl"]),
    ("curl", "curl", ["curl licen[cs]e", "spdx license identifier curl"]),
    ("ncsa", "ncsa", ["(?:university of illinois )?ncsa open source licen[cs]e", "spdx license identifier ncsa"]),
    ("afl-3.0", "academic", ["academic free licen[cs]e(?: " + VERSION + "[123](?: [012])?)?"]),
    ("osl-3.0", "open", ["open software licen[cs]e(?: " + VERSION + "[123](?: [01])?)?"]),
    ("odbl", "open", ["open (?:data commons )?(?:open )?database licen[cs]e(?: " + VERSION + "1(?: 0)?)?"]),
    ("odc-by", "open", ["open data commons attribution licen[cs]e(?: " + VERSION + "1(?: 0)?)?"]),
    ("ogl", "open", ["open government licen[cs]e(?: " + VERSION + "[123](?: 0)?)?"]),
    ("ms-pl", "microsoft", ["microsoft public licen[cs]e"]),
    ("ms-pl", "pl", ["spdx license identifier ms pl"]),
    ("ms-rl", "microsoft", ["microsoft reciprocal licen[cs]e"]),
    ("ms-rl", "rl", ["spdx license identifier ms rl"]),
    ("apsl", "apple", ["apple public source licen[cs]e(?: " + VERSION + "[12](?: [012])?)?"]),
    ("npl", "netscape", ["netscape public licen[cs]e(?: " + VERSION + "1 [01])?"]),
    ("qpl", "q", ["q public licen[cs]e(?: " + VERSION + "1(?: 0)?)?"]),
    ("sleepycat", "sleepycat", ["sleepycat licen[cs]e", "spdx license identifier sleepycat"]),
    ("lppl", "latex", ["latex project public licen[cs]e(?: " + VERSION + "1 [0123][abc]?)?"]),
    ("bsl-1.1", "business", ["business source licen[cs]e(?: " + VERSION + "1 1)?"]),
    ("sspl", "server", ["server side public licen[cs]e(?: " + VERSION + "1)?"]),
    ("sspl", "sspl", ["sspl(?: " + VERSION + "1(?: 0)?)?"]),
    ("elastic", "elastic", ["elastic licen[cs]e(?: " + VERSION + "2(?: 0)?)?"]),
    ("commons-clause", "clause", ["commons clause(?: licen[cs]e condition)?(?: " + VERSION + "1 0)?"]),
    ("polyform", "polyform", ["polyform (?:noncommercial|small business|shield|strict) licen[cs]e(?: 1 0 0)?"]),
    ("openrail", "openrail", ["(?:bigscience |creativeml )?openrail(?: m)?(?: licen[cs]e)?"]),
    ("llama", "llama", ["llama [23](?: [0-9])? community licen[cs]e(?: agreement)?"]),
    ("unicode", "unicode", ["unicode licen[cs]e(?: " + VERSION + "3)?", "unicode terms of use", "spdx license identifier unicode (?:dfs 201[56]|3 0)"]),
    ("w3c", "w3c", ["w3c software(?: notice and)? licen[cs]e", "spdx license identifier w3c"]),
    ("vim", "vim", ["vim licen[cs]e", "spdx license identifier vim"]),
    ("tcl", "tcl", ["tcl tk licen[cs]e", "spdx license identifier tcl"]),
    ("json", "json", ["json licen[cs]e", "spdx license identifier json"]),
    ("json", "evil", ["the software shall be used for good not evil"]),
    ("beerware", "beer", ["beer ware licen[cs]e"]),
    ("beerware", "beerware", ["the beerware licen[cs]e"]),
    ("upl-1.0", "permissive", ["universal permissive licen[cs]e(?: " + VERSION + "1(?: 0)?)?"]),
    ("mulan", "mulan", ["mulan (?:permissive software|psl) licen[cs]e(?: v[12])?"]),
    ("mulan", "mulanpsl", ["spdx license identifier mulanpsl [12] 0"]),
    ("blueoak", "blue", ["blue oak model licen[cs]e(?: 1 0 0)?"]),
    ("proprietary", "proprietary", ["proprietary licen[cs]e", "proprietary and confidential", "proprietary software licen[cs]e"]),
    ("all-rights-reserved", "reserved", ["all rights reserved"]),
    ("no-warranty", "warranty", ["without warranty of any kind(?: express or implied)?", "without even the implied warranty of merchantability"]),
    ("fair-source", "fair", ["fair source licen[cs]e(?: " + VERSION + "0 9)?"]),
    ("fair-source", "functional", ["functional source licen[cs]e"]),
    ("hippocratic", "hippocratic", ["hippocratic licen[cs]e(?: [123] [01])?"]),
]


def rule_table() -> list[tuple[str, str, str, int, float]]:
    """(label, keyword, regex, priority, weight) in order; the base phrases come first.

    An identifier line outranks a named version, which outranks a bare name; longer wording of one kind is certain, notices are not.
    """
    rules = [(label, "license", phrase, 0, 1.0) for phrase, label in BASE]
    for label, keyword, patterns in SIGNATURES:
        for pattern in patterns:
            if "identifier" in pattern:
                priority, weight = 3, 1.0
            elif label in ("no-warranty", "all-rights-reserved", "public-domain"):
                priority, weight = 1, 0.4
            else:
                priority, weight = 2, 0.9 if "licen" in pattern or len(pattern) > 40 else 0.7
            rules.append((label, keyword, pattern, priority, weight))
    return rules


RULES = rule_table()
RULE_TYPE = "array<struct<rule:int,label:string,keyword:string,pattern:string,priority:int,weight:double>>"


def rule_array() -> Column:
    fields = ("rule", "label", "keyword", "pattern", "priority", "weight")
    rows = [
        F.struct(*[F.lit(v).alias(n) for n, v in zip(fields, (i, label, keyword, f"(?<= )(?:{pattern})(?= )", priority, weight))])
        for i, (label, keyword, pattern, priority, weight) in enumerate(RULES)
    ]
    return F.array(*rows).cast(RULE_TYPE)


def spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def detections(words_text: Column, rule: Column) -> Column:
    """Places of one rule as (start, end, rule, label, priority, weight), in words, end exclusive."""
    empty = F.array().cast("array<struct<start:int,end:int,rule:int,label:string,priority:int,weight:double>>")
    found = F.regexp_extract_all(words_text, rule["pattern"], F.lit(0))
    between = F.split(words_text, rule["pattern"], -1)
    # before each match: the spaces of the stretches and matches so far, less the leading one
    steps = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, b: F.struct(spaces(b).alias("gap"), spaces(m).alias("inner")))

    def place(state, step):
        start = state["seen"] + step["gap"] - 1
        one = F.struct(start.alias("start"), (start + step["inner"] + 1).alias("end"), rule["rule"], rule["label"], rule["priority"], rule["weight"])
        return F.struct((state["seen"] + step["gap"] + step["inner"]).alias("seen"), F.concat(state["places"], F.array(one)).alias("places"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("seen"), empty.alias("places")), place, lambda state: state["places"])


def suppressed(found: Column) -> Column:
    """Detections without those inside another of at least their priority; base ones (priority 0) always stay.

    Sorted by start, then longest, then highest priority, one sweep keeps the furthest end of every priority; of equal
    intervals and priorities the earlier rule stays.
    """
    sort_key = lambda d: F.struct(d["start"].alias("s"), (-d["end"]).alias("e"), (-d["priority"]).alias("p"), d["rule"].alias("r"), d.alias("d"))
    ordered = F.transform(F.sort_array(F.transform(found, sort_key)), lambda x: x["d"])
    empty = F.slice(found, 1, 0)

    def sweep(state, d):
        inside = F.lit(False)
        for p in (1, 2, 3):
            inside = inside | ((d["priority"] <= p) & (state[f"end{p}"] >= d["end"]))
        inside = inside & (d["priority"] > 0)
        ends = [F.when(d["priority"] == p, F.greatest(state[f"end{p}"], d["end"])).otherwise(state[f"end{p}"]).alias(f"end{p}") for p in (1, 2, 3)]
        return F.struct(*ends, F.when(inside, state["out"]).otherwise(F.concat(state["out"], F.array(d))).alias("out"))

    start = F.struct(*[F.lit(-1).alias(f"end{p}") for p in (1, 2, 3)], empty.alias("out"))
    return F.aggregate(ordered, start, sweep, lambda state: state["out"])


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: ``row`` (the input row whole), n_words, base and spans.

    ``base``: places of the base phrases; ``spans``: all detections left after suppression, both as (start, end, rule, label, priority,
    weight) in words, ordered by start. Null or empty text: zero words, no spans. Repeated rows give repeated results.
    """
    keywords = sorted({rule[1] for rule in RULES})
    stage = docs.select(F.struct(*docs.columns).alias("row"), F.regexp_extract_all(ascii_lower(text_of()), F.lit(WORD), F.lit(0)).alias("_words"))
    stage = stage.select("row", "_words", F.array_intersect(F.array(*[F.lit(k) for k in keywords]), F.col("_words")).alias("_gates"))
    joined = F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" "))
    stage = stage.select("row", F.size("_words").cast("long").alias("n_words"), "_gates", F.when(F.size("_gates") > 0, joined).alias("_text"))
    gated = F.filter(rule_array(), lambda r: F.array_contains(F.col("_gates"), r["keyword"]))
    places = F.flatten(F.transform(gated, lambda r: detections(F.col("_text"), r)))
    none = F.array().cast("array<struct<start:int,end:int,rule:int,label:string,priority:int,weight:double>>")
    stage = stage.select("row", "n_words", F.when(F.size("_gates") > 0, places).otherwise(none).alias("_found"))
    base = F.filter("_found", lambda d: d["rule"] < len(BASE))
    return stage.select("row", "n_words", base.alias("base"), suppressed(F.col("_found")).alias("spans"))


def labels_of(spans: str) -> Column:
    return F.array_join(F.sort_array(F.array_distinct(F.transform(spans, lambda d: d["label"]))), ",")


@query("op2_licenses")
def op2(spark, folder):
    scanned = scan_licenses(documents(spark, folder).select("doc_id", "text"))
    starts = F.transform("base", lambda d: d["start"].cast("long"))
    return scanned.select(
        "row.doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels_of("base").alias("base_labels"),
        labels_of("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda d: d["weight"])), F.lit(0.0)).alias("score"),
    )
