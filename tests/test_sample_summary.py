"""The summary of samples is one aggregate, with the median of each whole key."""

from carrierlake.operators import variants


def test_sample_summary_is_one_aggregate(spark):
    rows = [("a", "x", 1, "WT", 10.0), ("a", "x", 1, "WT", 20.0), ("a", "x", 2, "Het_ALT", float("nan")), ("a", "x", 3, "No_call", None),
            ("b", None, 1, "WT", 7.0), ("c", "y", 4, "Hom_ALT", None)]
    long = spark.createDataFrame(rows, "sample string, cohort string, locus int, status string, dp double")
    out = variants.sample_summary(long, "locus", ["sample", "cohort"])
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r["sample"]: (r.n_loci, r.n_wt, r.n_het_alt, r.n_no_call, r.median_dp) for r in out.collect()}
    assert got == {"a": (3, 2, 1, 1, 15.0), "b": (1, 1, 0, 0, None), "c": (1, 0, 0, 0, None)}
