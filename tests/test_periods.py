import random

from corrobora.operators import periods as P

LINKEDIN = "record_id string, pos int, companyname string, title string, start_year int, start_month int, end_year int, end_month int, iscurrent boolean, kind string"
HISTORY = "record_id string, pos int, org string, role_title string, from_raw string, to_raw string, s int"


def run(spark, linkedin=(), history=()):
    a, b = spark.createDataFrame(list(linkedin), LINKEDIN), spark.createDataFrame(list(history), HISTORY)
    return sorted((r.record_id, r.first_month, r.kind, r.last_month) for r in P.continuous_periods(a, b).collect())


def post(rid, sy, sm, ey, em, cur=None):
    return (rid, 0, "c", "t", sy, sm, ey, em, cur, "clash")


def test_overlaps_nests_gaps(spark):
    rows = [post("a", 2000, 1, 2000, 6), post("a", 2000, 7, 2001, None), post("a", 2000, 3, 2000, 4), post("a", 2003, 5, 2003, 5), post("a", 2003, 5, 2003, 5)]
    assert run(spark, rows) == [("a", 200001, "period", 200112), ("a", 200201, "gap", 200304), ("a", 200305, "period", 200305)]


def test_what_counts(spark):
    rows = [
        post("year", 2000, None, 2000, 99), post("open", 2020, 2, None, None, True), post("none", 2020, 2, None, None), post("turned", 2020, 2, 2019, 1), post("future", 2026, 9, 2027, 1),
        post("cut", 2026, 1, 2031, 1), post("nostart", None, 1, 2020, 1), (None, 0, "c", "t", 2000, 1, 2000, 2, None, ""), post("both", 2010, 1, 2010, 2, True),
    ]
    assert run(spark, rows) == [("both", 201001, "period", 201002), ("cut", 202601, "period", 202608), ("open", 202002, "period", 202608), ("year", 200001, "period", 200012)]


def test_free_dates(spark):
    forms = {"22 Sep 2014": 201409, "FEB-2021": 202102, "2004.04": 200404, "9/2008": 200809, "2026/4": 202604, "in 2011": 201101, " 2009": 200901, "2019-02-06": 201902, "August 2004": 200408}
    rows = [(k, 0, "o", "r", k, "present", 1) for k in forms] + [("bad", 0, "o", "r", "soon", "present", 1), ("null", 0, "o", "r", None, None, 1), ("tba", 0, "o", "r", "2001", "tba", 1), ("m13", 0, "o", "r", "2003-13", " NOW ", 1)]
    got = {r[0]: r[1] for r in run(spark, history=rows)}
    assert got == forms | {"m13": 200301}


def test_empty(spark):
    assert run(spark) == []


def test_one_record_with_all_rows_against_brute_force(spark):
    rnd = random.Random(4)
    rows = [(r, s, s + rnd.randrange(0, 5)) for r in "ab" for s in (rnd.randrange(24000, 24300) for _ in range(400 if r == "a" else 12))]
    got = sorted((r[0], r.s, r.e) for r in P.merge_periods(spark.createDataFrame(rows, "record_id string, s int, e int")).collect())
    want = []
    for r in "ab":
        months = sorted({m for k, s, e in rows if k == r for m in range(s, e + 1)})
        for m in months:
            if want and want[-1][0] == r and want[-1][2] == m - 1:
                want[-1] = (r, want[-1][1], m)
            else:
                want.append((r, m, m))
    assert got == want


def test_plan_folds_before_it_shuffles(spark):
    df = spark.createDataFrame([("a", 1, 2)], "record_id string, s int, e int")
    plan = P.merge_periods(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "MergingSessions" in plan
