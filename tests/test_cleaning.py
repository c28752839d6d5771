from aestudy.functions.cleaning import band_issue_year, clean_strings, collapse_levels, nan_to_null


def test_clean_strings_touches_only_strings_and_keeps_order(spark):
    df = spark.createDataFrame([("  Term ", 3, "\tx "), (None, None, "a b")], "plan string, n int, `odd.name` string")
    out = clean_strings(df)
    assert out.columns == df.columns
    assert [tuple(r) for r in out.collect()] == [("TERM", 3, "\tX"), (None, None, "A B")]


def test_collapse_levels_applies_steps_in_order(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), ("z",), (None,)], "v string")
    out = collapse_levels(df, "v", {"b": ["a"], "d": ["b", "c"]})
    assert [r.v for r in out.collect()] == ["d", "d", "d", "z", None]


def test_issue_year_bands(spark):
    years = [1900, 1980, 1980.5, 1981, 1996, 1996.5, 1997, 2003, 2004, 2008, 2009, 2030, None]
    out = band_issue_year(spark.createDataFrame([(y if y is None else float(y),) for y in years], "Issue_Year double"))
    assert [r.Issue_Year_Group for r in out.collect()] == [
        *["≤1980", "≤1980", "1981-1996", "1981-1996", "1981-1996", "Unknown", "1997-2003", "1997-2003"],
        *["2004-2008", "2004-2008", "2009+", "2009+", "Unknown"],
    ]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, 2)], "x double, n int")
    assert [r.x for r in nan_to_null(df).collect()] == [None, 2.0]
