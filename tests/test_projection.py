import pytest

from corrobora.plans.config import DEFAULT, RECRUITER_VIEW, ConfigError, compile_query, parse_path, path_type
from corrobora.plans.projection import project
from corrobora.plans.report import as_documents

SCHEMA = (
    "candidate_id string, full_name string, emails array<string>, phones array<string>, location struct<city:string,region:string,country:string>, "
    "skills array<struct<name:string,canonical:boolean,confidence:double,sources:array<string>>>, "
    "provenance array<struct<field:string,source:string,method:string,alternatives:array<string>>>, field_confidence map<string,double>, overall_confidence double"
)


@pytest.fixture(scope="module")
def profiles(spark):
    prov = [("emails[0]", "a", "m", []), ("emails[1]", "b", "m", []), ("full_name", "a", "m", ["X"]), ("full_name", "a", "m", ["X"]), ("location", "z", "m", [])]
    rows = [
        ("1", "Mira", ["a@x.co", "b@x.co"], ["+14155552671"], ("Pune", None, "IN"), [("python", True, 0.9, ["s"]), (None, False, 0.1, ["s"])], prov, {"emails": 0.9, "full_name": 0.8}, 0.5),
        ("2", None, [], ["12"], None, [], [], {}, 0.0),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def out(profiles, **config):
    q = compile_query(config)
    records, validation, notes = project(profiles, q)
    return as_documents(records, q), [tuple(r) for r in validation.orderBy("candidate_id", "field").collect()], [tuple(r) for r in notes.collect()]


def test_paths():
    assert parse_path("skills[].name") == [("skills", "[]"), ("name", None)] and parse_path("emails[0]") == [("emails", 0)]
    assert path_type("skills[].name") == "string[]" and path_type("emails[3]") == "string" and path_type("experience[0].is_current") == "boolean" and path_type("emails[]") == "string[]"
    for bad in ("a..b", "a[x]", "skills[].name[]", "nope", "skills[].sources", ""):
        with pytest.raises(ConfigError):
            path_type(bad)


def test_all_problems_come_together():
    fields = [
        {"path": "x", "from": "shoe_size", "type": "string"}, {"path": "mails[2]", "from": "emails", "type": "string[]"}, {"path": "full_name", "type": "string", "normalize": "E164"},
        {"path": "full_name.first", "from": "full_name", "type": "string"}, {"path": "n", "from": "emails", "type": "number", "normalize": "lower"}, {"type": "string"}, "x", {"path": "q", "from": "headline", "type": "text"},
        {"path": "r", "from": "headline", "type": "string", "normalize": "zip"}, {"path": "a..b", "from": "headline", "type": "string"}, {"path": "full_name", "from": "headline", "type": "string"},
    ]
    with pytest.raises(ConfigError) as e:
        compile_query({"fields": fields, "on_missing": "guess"})
    by_field = {}
    for text in e.value.errors:
        by_field.setdefault(text.partition(" (")[0] if text.startswith("field") and "(" in text else " ".join(text.split()[:2]), []).append(text)
    assert {k: len(v) for k, v in by_field.items()} == {
        "field 1": 1, "field 2": 1, "field 3": 1, "field 4": 1, "field 5": 2, "field 6": 1, "field 7": 1, "field 8": 1, "field 9": 1, "field 10": 1, "field 11": 1, "on_missing is": 1,
    }
    for empty in ({}, {"fields": []}, {"fields": "all"}):
        with pytest.raises(ConfigError, match="isn't empty"):
            compile_query(empty)
    assert len(compile_query(DEFAULT).fields) == 12 and compile_query(RECRUITER_VIEW).fields[1].required


def test_outputs_that_overlap():
    f = lambda *paths: {"fields": [{"path": p, "from": "headline", "type": "string"} for p in paths]}
    assert len(compile_query(f("a.b", "a.c", "ab", "b.a")).fields) == 4
    for paths in (("a", "a"), ("a", "a.b"), ("a.b", "a"), ("a.b.c", "x", "a.b")):
        with pytest.raises(ConfigError) as e:
            compile_query(f(*paths))
        assert len(e.value.errors) == 1 and "writes where field 1" in e.value.errors[0]


NAME = {"path": "who.name", "from": "full_name", "type": "string"}
SECOND = {"path": "second", "from": "emails[1]", "type": "string"}


@pytest.mark.parametrize(("mode", "want", "bad"), [("null", [{"who": {"name": "Mira"}, "second": "b@x.co"}, {"who": {"name": None}, "second": None}], []), ("omit", [{"who": {"name": "Mira"}, "second": "b@x.co"}], [("2", "<schema>")]), ("error", [{"who": {"name": "Mira"}, "second": "b@x.co"}], [("2", "second"), ("2", "who.name")])])
def test_on_missing(profiles, mode, want, bad):
    docs, validation, _ = out(profiles, fields=[NAME, SECOND], on_missing=mode)
    assert docs == want and [v[:2] for v in validation] == bad


def test_omit_leaves_single_fields_out(profiles):
    docs, validation, _ = out(profiles, fields=[SECOND, {"path": "candidate_id", "type": "string"}], on_missing="omit")
    assert docs == [{"second": "b@x.co", "candidate_id": "1"}, {"candidate_id": "2"}] and not validation


def test_required_maps_and_normalizers(profiles):
    docs, validation, notes = out(profiles, fields=[{"path": "names", "from": "skills[].name", "type": "string[]", "normalize": "canonical"}, {"path": "tel", "from": "phones[0]", "type": "string", "normalize": "E164"}, {"path": "land", "from": "location.country", "type": "string", "normalize": "ISO3166", "required": True}])
    assert docs == [{"names": ["python"], "tel": "+14155552671", "land": "IN"}]
    assert validation == [("2", "land", "required_missing")]
    assert notes == [("2", "tel", "12", "not E.164-normalizable without region context: '12'")]


def test_provenance_and_confidence(profiles):
    docs, _, _ = out(profiles, fields=[{"path": "mail", "from": "emails", "type": "string[]"}, {"path": "n", "from": "full_name", "type": "string", "normalize": "lower"}], include_provenance=True, include_confidence=True)
    assert [p["field"] for p in docs[0]["provenance"]] == ["mail[0]", "mail[1]", "n"] and docs[0]["n"] == "mira"
    assert docs[0]["confidence"] == {"overall": 0.5, "fields": {"mail": 0.9, "n": 0.8}} and docs[1]["mail"] == []


def test_only_needed_columns_are_read(spark, profiles, tmp_path):
    profiles.write.parquet(str(tmp_path / "p"))
    q = compile_query({"fields": [NAME]})
    plan = project(spark.read.parquet(str(tmp_path / "p")), q)[0]._jdf.queryExecution().executedPlan().toString()
    assert "full_name" in plan and "skills" not in plan and "provenance" not in plan
