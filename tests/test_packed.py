import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corrobora.operators import packed as P

MODEL = {"tcp/ip": 40.0, "planning and scheduling": 30.0, "extract and load": 30.0, "go": 300.0, "python": 200.0, "java": 100.0, "n/a": 5.0}


def split(text):
    return P.split_values(text, P.Lattice(MODEL))


def test_formats():
    assert split('["Go", null, "a, b", "\\uff47\\uff4f", "n/a", 3]') == ["Go", "a, b", "ｇｏ", "3"]
    assert split("Go; python ;java") == ["Go", "python", "java"]
    assert split("1) Go 2) Python 3 3) C++") == ["Go", "Python 3", "C++"]
    assert split("• Go\n• c#\r\n- java") == ["Go", "c#", "java"]
    assert split('"go (4 years, daily)";"Mood boards; collage";""') == ["go (4 years, daily)", "Mood boards; collage"]
    assert split('say ""x""|"a ""b"" c"') == ['say ""x""', 'a "b" c']
    assert split("go, python, and java (work, hobby)") == ["go", "python", "java (work, hobby)"]
    assert split("go / tcp/ip / python") == ["go", "tcp/ip", "python"]
    assert split("，go、python，") == ["go", "python"]


def test_lattice():
    assert split("planning and scheduling and go") == ["planning and scheduling", "go"]
    assert split("Planning And Scheduuling, go and python") == ["Planning And Scheduuling", "go", "python"]
    assert split("advanced extract and load and kubenretes") == ["advanced extract and load", "kubenretes"]
    assert split("tcpi/p") == ["tcpi/p"] and split("java/go") == ["java", "go"]
    assert split("n/a, -, go") == ["go"]


def test_nothing():
    assert split(None) == [] and split("") == [] and split(" — ") == [] and split("[]") == [] and split('["go"') == ["go"]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text_is_split_without_losing_letters(text):
    kept = "".join(split(text))
    assert len([c for c in kept if c.isalnum()]) <= len([c for c in text if c.isalnum()]) or text.strip().startswith("[")


@given(st.lists(st.sampled_from(["go", "Python 3", "c++", "node.js", "machine learning", "機械学習 (machine learning)"]), min_size=1, max_size=6), st.sampled_from(["; ", ",", " | ", "\n", "、", " / ", "\t"]))
def test_round_trip(values, sep):
    assert split(sep.join(values)) == values


def test_long_text():
    assert len(split("go," * 50_000)) == 50_000


def test_operator(spark):
    rows = [("a", "Go and python; java", 1), ("a", "Go and python; java", 1), ("b", None, 2), (None, "x", 3), ("c", "", 4)]
    df = spark.createDataFrame(rows, "record_id string, skills string, pos int")
    got = sorted((str(r.record_id), r.pos, r.skill) for r in P.unpack(df, "skills", ["record_id"], "skill").collect())
    assert got == sorted([("None", 0, "x")] + 2 * [("a", 0, "Go"), ("a", 1, "python"), ("a", 2, "java")])
    assert P.unpack(df.limit(0), "skills", ["record_id"]).count() == 0


def test_learning_finds_joined_values(spark):
    rows = [('["plan and run", "go"]',)] * 40 + [("go and plan and run",), ("plan and run and go",)]
    model = P.learn_lattice(spark.createDataFrame(rows, "t string"), "t")
    assert round(model["plan and run"], 2) == 42 and round(model["go"], 2) == 42 and "go and plan" not in model


def _uncertain(spark):
    """A joined value seen twice for sure, its two halves often alone, and many chunks that may be either."""
    rows = [('["soap and candles"]',)] * 2 + [("soap",)] * 95 + [("candles",)] * 95 + [("go",)] * 1800 + [("soap and candles",)] * 200
    return spark.createDataFrame(rows, "t string")


def test_expected_counts_decide(spark):
    """Hard counts of the first split would keep the halves apart for ever; shares of all splits move over to the joined value."""
    df = _uncertain(spark)
    first = P.Model({"soap and candles": 2.0, "soap": 95.0, "candles": 95.0, "go": 1800.0})
    assert P.split_values("soap and candles", P.Lattice(first)) == ["soap", "candles"]
    learned = P.learn_lattice(df, "t")
    assert P.split_values("soap and candles", P.Lattice(learned)) == ["soap and candles"]
    assert 195 < learned["soap and candles"] < 203 and 94 < learned["soap"] < 103


def test_learning_that_does_not_settle_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(P, "ROUNDS", 1)
    with pytest.raises(RuntimeError, match="not settled"):
        P.learn_lattice(_uncertain(spark), "t")


def test_expected_counts_by_enumeration():
    import itertools
    import math

    lattice = P.Lattice({"a and b": 3.0, "a": 5.0, "b": 4.0, "c": 9.0, "b and c": 1.0}, {"and": 0.4})
    pieces, total, want = ["a", "b", "c"], 0.0, {}
    for cuts in itertools.product([0, 1], repeat=2):
        values, run = [], ["a"]
        for cut, x in zip(cuts, pieces[1:]):
            run = run + [x] if not cut else (values.append(" and ".join(run)) or [x])
        values.append(" and ".join(run))
        w = math.exp(sum(lattice.score(v) for v in values)) * math.prod(0.4 if c else 0.6 for c in cuts)
        total += w
        for v in values:
            want[v] = want.get(v, 0.0) + w
    got = lattice.expected("a and b and c")
    for v, w in want.items():
        if w / total > 1e-3:
            assert math.isclose(got[v], w / total, rel_tol=1e-6)
    assert math.isclose(got[P._LIKELY], math.log(total), rel_tol=1e-9)


def test_strong_delimiters_inside_known_values(spark):
    rows = [('"Mood boards; collage", go',)] * 3 + [("go; Mood boards; collage; python",), ("mood; boards",), ("python",)]
    df = spark.createDataFrame(rows, "t string")
    model = P.learn_lattice(df, "t")
    assert P.split_values("go; Mood boards; collage; python", P.Lattice(model)) == ["go", "Mood boards; collage", "python"]
    assert P.split_values("mood; boards", P.Lattice(model)) == ["mood", "boards"]


def test_rare_joined_values_stay_whole_in_a_large_column(spark):
    often = "[" + ", ".join(['"go"', '"python"'] * 50) + "]"
    rows = [(f"r{i}", often) for i in range(2000)] + [("a", '["fold and mend", "flux/grid"]'), ("b", "fold and mend, go"), ("c", "go and fold and mend; flux/grid"), ("d", "go/python"), ("d", "go/python"), ("e", None)]
    df = spark.createDataFrame(rows, "id string, t string")
    model = P.learn_lattice(df, "t")
    assert set(model) == {"go", "python"} and {r.k: round(r.n) for r in model.rare.collect()} == {"fold and mend": 3, "flux/grid": 2}
    got = sorted((r.id, r.pos, r.value) for r in P.unpack(df.where("length(id) = 1"), "t", ["id"], model=model).collect())
    assert got == [("a", 0, "fold and mend"), ("a", 1, "flux/grid"), ("b", 0, "fold and mend"), ("b", 1, "go"), ("c", 0, "go"), ("c", 1, "fold and mend"), ("c", 2, "flux/grid"), ("d", 0, "go"), ("d", 0, "go"), ("d", 1, "python"), ("d", 1, "python")]
    assert P.unpack(df, "t", ["id"], model=model).count() == 200_000 + len(got)


def test_edits():
    assert P.edits("abcd", "abdc", 2) == 1 and P.edits("kitten", "sitting", 3) == 3 and P.edits("a", "abcdef", 2) == 3
