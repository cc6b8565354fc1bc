import unicodedata

import pytest
from pyspark.sql import functions as F

from corrobora.functions import contacts as C
from corrobora.functions import partial_dates as D
from corrobora.functions import skills as S
from corrobora.functions import text as T


def col(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_text_forms(spark):
    assert col(spark, ["\tÅSA ", "Großmann", None, ""], T.fold_col) == ["åsa", "grossmann", None, ""]
    assert col(spark, [unicodedata.normalize("NFD", "Çelik"), "Ångström"], T.unaccent_col) == ["celik", "angstrom"]
    assert col(spark, [" TBD. ", "--", "–", "nil", "?", "Nilla", None], T.null_marker_col) == [True, True, True, True, True, False, None]


def test_emails(spark):
    raw = ["\u00a0Orla.Venn@Inkpost.EXAMPLE;", "[orla@inkpost.example]", "orla at inkpost", "orla@inkpost", "orla@ink post.example", None]
    assert col(spark, raw, C.email_normalized) == ["orla.venn@inkpost.example", "orla@inkpost.example", None, None, None, None]
    keys = ["o.r.l.a+cv+2@gmail.com", "orla@googlemail.com", "orla.venn+x@inkpost.example", "ORLA@Inkpost.example"]
    assert col(spark, keys, C.email_match_key) == ["orla@gmail.com", "orla@gmail.com", "orla.venn@inkpost.example", "orla@inkpost.example"]
    assert col(spark, ["x@y.example,,z@y.example\tw@y.example"], C.split_emails) == [["x@y.example", "z@y.example", "w@y.example"]]


@pytest.mark.parametrize(
    ("raw", "region", "want"),
    [
        ("+49 (0)151 2345 6789", None, "+4915123456789"), ("0151/23456789", "DE", "+4915123456789"), ("015123456789", None, None), ("+33 6 12 34 56 78 x9", None, "+33612345678"),
        ("call me", "DE", None), ("", "DE", None), ("+33612345678", "DE", "+33612345678"), ("212.736.5000", "CA", "+12127365000"), ("+1 211 736 5000", None, None), ("+800 1234 5678", None, None),
        ("06 12 34 56 78", "FR", "+33612345678"), ("0612345678", "XX", None),
    ],
)
def test_e164(raw, region, want):
    assert C.to_e164(raw, region) == want
    assert want is None or C.to_e164(want) == want


def test_phone_cells(spark):
    assert col(spark, ["+33612345678;0151 234 / office", "7 and 8, -"], C.split_phones) == [["+33612345678", "0151 234"], ["7", "8"]]
    assert col(spark, ["+33 6 12 34 56 78 EXT. 4", "x5"], C.strip_extension) == ["+33 6 12 34 56 78", ""]


def test_urls(spark):
    urls = ["HTTP://LinkedIn.com/in/Orla-Venn/;", "github.com/ovenn//?q=1#top", "https://ovenn.example/github.com"]
    assert col(spark, urls, C.url_bucket) == ["linkedin", "github", "other"]
    assert col(spark, urls, C.url_match_key) == ["linkedin.com/in/orla-venn", "github.com/ovenn", "ovenn.example/github.com"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("hired SEPT. 2014", (2014, 9)), ("december, 1999", (1999, 12)), ("1998/7", (1998, 7)), ("7-1998", (1998, 7)), ("in 2003", (2003, None)), ("2014-11-30T08:00", (2014, 11)),
        ("25-12-2014", (2014, 12)), ("5/6/2014", (2014, None)), ("6/6/2014", (2014, 6)), ("some day", None), ("2014-00", (2014, None)), ("now, since 2003", (2003, None)), ("31/32/2014", (2014, None)),
    ],
)
def test_dates(raw, want):
    assert D.parse(raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Apr 2009 till date", ((2009, 4), None, True)), ("1998—2003", ((1998, None), (2003, None), False)), ("Since Aug 2011, remote", ((2011, 8), None, True)),
        ("7/1998 until 2003-02", ((1998, 7), (2003, 2), False)), ("1998, then a long while nothing, 2003", None), ("current", None), (" ", None),
    ],
)
def test_ranges(raw, want):
    assert D.parse_range(raw) == want


def test_date_columns(spark):
    got = col(spark, ["2020-01", "2019", "x", None], D.parse_col)
    assert [None if g is None else (g.y, g.m) for g in got] == [(2020, 1), (2019, None), None, None]
    assert D.render((2019, None)) == "2019" and D.month_index((2019, None), "end") - D.month_index((2019, None), "start") == 11


def test_skills_and_countries(spark):
    assert S.canonical_skill(" K8S 1.29 ") == ("kubernetes", True)
    assert S.canonical_skill("Lamp Shade Folding!") == ("lamp shade folding", False)
    assert S.canonical_skill("日本") == ("", False)
    found = S.SkillScanner().find("We go over Python, JavaScript and c++; not pythonic.")
    assert list(found) == ["c++", "javascript", "python"] and found["python"] == (11, 17)
    assert S.country_code("DE", codes=False) is None and S.country_code("us", codes=False) == "US" and S.country_code(" Deutschland. ") == "DE"
    assert col(spark, [" India ", "Narnia", None], S.country_code_col) == ["IN", None, None]


def test_round6(spark):
    df = spark.createDataFrame([(0.9531025,), (2.675e-6,), (None,)], "v double")
    assert [r[0] for r in df.select(T.round6(F.col("v"))).collect()] == [round(0.9531025, 6), round(2.675e-6, 6), None]
