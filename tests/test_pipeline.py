import hashlib
import json
import logging

import pytest
from pyspark.sql import functions as F

from corrobora.cli import main
from corrobora.operators import identity, merge
from corrobora.plans.config import DEFAULT, RECRUITER_VIEW, compile_query
from corrobora.plans.report import dumps, run, run_scan
from corrobora.plans.schema import json_schema, violations
from corrobora.sources.formats import ADAPTERS, Adapter, Tools, clean_pages, parse_file, register, resume_name
from corrobora.sources.grammar import Line, read_text
from corrobora.sources.scan import raw_files, scan
from corrobora.sources.synthetic import people as made_up
from corrobora.sources.tables import ats_atoms, roster_atoms
from tests.fixtures import people


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("files")
    people(d)
    return d


@pytest.fixture(scope="module")
def done(spark, folder):
    return run(spark, f"{folder}/*", DEFAULT)


def test_sources(done):
    s = {r.source_id: r for r in done.scan.sources.collect()}
    assert {k: v.status for k, v in s.items()} == {
        "roster.csv": "partial", "latin.csv": "ok", "wide.csv": "ok", "ats.json": "partial", "github_mira.json": "ok", "linkedin_tom.json": "ok", "note_mira.txt": "ok", "note_two.txt": "ok",
        "resume_tom.docx": "ok", "resume_ulla.pdf": "ok", "broken.json": "skipped", "fake.pdf": "skipped", "page.csv": "skipped", "empty.txt": "ok",
    }
    assert s["roster.csv"].records_read == 5 and s["roster.csv"].errors == ["roster.csv#row=3: column-shifted row skipped"]
    assert [r[0] for r in done.scan.unrecognized.collect()] == ["notes.md"]
    assert ("roster.csv", "emails", "not-mail", "not_an_email") in {tuple(r) for r in done.scan.unreadable.collect()}


def test_profiles(done):
    docs = {d["full_name"]: d for d in done.documents()}
    mira = docs["Mira Solano"]
    assert mira["emails"][0] == "mira@solano.example" and mira["phones"] == ["+14155552671"]
    assert mira["location"] == {"city": "Utrecht", "country": "NL", "region": None}
    assert mira["links"] == {"github": "https://github.com/mirasolano", "linkedin": None, "portfolio": "https://mirasolano.dev", "other": []}
    assert mira["years_experience"] == 10.3  # 24 months from 2016-01, then 100 from 2018-02 to 2026-05
    assert [x["title"] for x in mira["experience"]] == ["Staff Engineer", "Dev", "Lead"]
    assert {"field": "years_experience", "source": "derived:experience", "method": "derived:experience_intervals_v1", "alternatives": ["15"]} in mira["provenance"]
    assert "Ulla Ström" in docs and "José Peña" in docs
    assert sum("multi_identity_source" in d["flags"] for d in done.documents()) == 1


def test_refusal_and_report(done):
    report = done.report()
    assert [r["key"] for r in report["merges"]["refusals"]] == 2 * ["phone:+14155552671"]  # once for each record the smallest is compared with
    assert report["run"]["as_of"] == "2026-05" and report["unrecognized_files"] == ["notes.md"]
    ids = [d["candidate_id"] for d in done.documents()]
    assert len(ids) == len(set(ids)) == len(report["merges"]["clusters"]) and ids == sorted(ids)


def test_order_and_partitions_do_not_matter(spark, folder, done):
    files = raw_files(spark, f"{folder}/*").orderBy(F.desc("source_id")).repartition(3, F.rand(1))
    again = run_scan(scan(files), compile_query(DEFAULT))
    assert dumps(again.documents()) == dumps(done.documents()) and again.output_hash() == done.output_hash()


def test_removing_a_corroborator_never_raises_confidence(spark, folder, done):
    less = run_scan(scan(raw_files(spark, f"{folder}/*").where("source_id <> 'note_mira.txt'")), compile_query(DEFAULT))
    a, b = ({d["full_name"]: d["confidence"]["fields"] for d in r.documents()}["Mira Solano"] for r in (done, less))
    assert b["emails"] < a["emails"] and b["full_name"] <= a["full_name"]


def test_views_and_strict(spark, folder):
    r = run(spark, f"{folder}/*", RECRUITER_VIEW)
    docs = r.documents()
    assert all(set(d) == {"full_name", "primary_email", "phone", "skills", "confidence"} for d in docs)
    assert {x["problem"] for x in r.report()["validation"]} == {"required_missing"}
    with pytest.raises(Exception, match="JSONDecodeError|Expecting|Unterminated"):
        run(spark, f"{folder}/broken.json", DEFAULT, strict=True)


def test_command_line(folder, tmp_path, capsys):
    assert main(["run", "--input", str(folder / "roster.csv"), "--config", "recruiter_view", "--out", str(tmp_path / "o/p.json"), "--report", str(tmp_path / "r.json")]) == 0
    assert [d["primary_email"] for d in json.loads((tmp_path / "o/p.json").read_text())]
    assert main(["run", "--input", str(folder / "nothing")]) == 2
    assert main(["run", "--input", str(folder / "broken.json")]) == 2
    assert main(["run", "--input", str(folder), "--as-of", "soon"]) == 2
    bad = tmp_path / "bad.json"
    bad.write_text('{"fields": []}')
    assert main(["run", "--input", str(folder), "--config", str(bad)]) == 2
    capsys.readouterr()


def test_text_helpers():
    assert clean_pages(["Head\na\nmigra-", "Head\ntion"]) == "Head\na\nmigration"
    heading = lambda s: Line(s, 0, len(s)).heading
    assert heading("pastry chef, Kite Labs") is None and heading("Pastry Chef — Kite Labs") == ("Kite Labs", "Pastry Chef") and heading("Kite | Chef") == ("Kite", "Chef") and heading("Kite, May 2019") is None
    assert resume_name("\n  Carlos Núñez | Cook\n") == "Carlos Núñez" and resume_name("Curriculum Vitae") is None


ATOM = "source_id string, source_type string, record_id string, updated_at string, field_path string, value string, raw_value string, method string, order_index int, normalized boolean, locator string"


def atoms(spark, rows):
    """rows: record_id, source_type, updated_at, [(path, value, method)]."""
    out = [
        (rid.split("#")[0], kind, rid, stamp, path, v if isinstance(v, str) else json.dumps(v, sort_keys=True), None, method, i, True, None)
        for rid, kind, stamp, atoms_ in rows
        for i, (path, v, method) in enumerate(atoms_)
    ]
    return spark.createDataFrame(out, ATOM)


def job(company, title, start, end, current):
    return ("experience", {"company": company, "title": title, "start": start, "end": end, "is_current": current, "summary": None}, "direct_field")


def one(spark, rows, as_of=(2026, 8), flags=()):
    a = atoms(spark, rows)
    members = a.select("record_id").distinct().withColumn("cluster_id", F.lit("c"))
    clusters = spark.createDataFrame([("c", list(flags))], "cluster_id string, flags array<string>")
    m = merge.merge(a, members, clusters, spark.createDataFrame([], "key string"), as_of)
    return m.profiles.first().asDict(True), {r.reason for r in m.notes.collect()}


def test_hand_computed_confidence(spark):
    name = lambda v, m="direct_field": [("full_name", v, m)]
    p, _ = one(spark, [("ats.json#idx=0", "ats_json", None, name("X")), ("r.csv#row=1", "recruiter_csv", None, name("X")), ("n.txt#file", "notes_txt", None, name("Y", "regex:n"))])
    assert p["field_confidence"]["full_name"] == round(0.985 * 1.75 / 2.20, 6) == 0.783523
    p, _ = one(spark, [("r.csv#row=1", "recruiter_csv", None, name("X")), ("r.csv#row=5", "recruiter_csv", None, name("X"))])
    assert p["field_confidence"]["full_name"] == 0.85 and p["overall_confidence"] == round(3 * 0.85 / 17, 6)
    p, _ = one(spark, [("ats.json#idx=0", "ats_json", "2026-01", name("Old")), ("b.json#idx=0", "ats_json", "2026-02", name("New")), ("c.json#idx=0", "ats_json", None, name("None"))])
    assert p["full_name"] == "New"


def test_location_stays_whole_and_posts_merge(spark):
    place = lambda **x: [("location", {"city": None, "region": None, "country": None} | x, "direct_field")]
    p, _ = one(spark, [("a.json#idx=0", "ats_json", None, place(city="Pune")), ("r.csv#row=1", "recruiter_csv", None, place(city="Goa", country="IN"))])
    assert p["location"] == {"city": "Goa", "region": None, "country": "IN"}
    p, _ = one(spark, [("n.txt#file", "notes_txt", None, [job("Órbita", "Baker", None, None, True)]), ("l.json#profile", "linkedin_json", None, [job("ORBITA", "Head baker", [2011, 9], None, True)]), ("r.csv#row=9", "recruiter_csv", None, [job("Kite", None, None, None, True)])])
    assert [(x["company"], x["title"], x["start"], x["is_current"]) for x in p["experience"]] == [("ORBITA", "Head baker", "2011-09", True), ("Kite", None, None, True)]
    p, _ = one(spark, [("l.json#profile", "linkedin_json", None, [job("Kite", "A", [2004, 5], [2006, 1], False), job("Kite", "B", [2006, 2], [2007, 1], False), job("Kite", "C", [2005, 12], [2006, 1], False)])])
    assert [(x["title"], x["start"], x["end"]) for x in p["experience"]] == [("B", "2006-02", "2007-01"), ("A", "2004-05", "2006-01")]


@pytest.mark.parametrize(
    ("posts", "as_of", "years", "notes"),
    [
        ([job("A", "x", [2009, 1], [2010, 6], False), job("B", "y", [2010, 4], [2011, 3], False), job("C", "z", [2013, 1], [2013, 3], False)], (2014, 1), 2.5, set()),
        ([job("A", "x", [2013, 11], None, True)], (2014, 1), 0.3, set()),
        ([job("A", "x", [2013, 11], None, True)], None, None, set()),
        ([job("A", "x", [2012, 3], [2011, 12], False), job("B", "x", [2001, None], [2002, None], False)], (2014, 1), 2.0, {"inverted_date_range"}),
        ([job("A", "x", [2014, 2], [2014, 9], False)], (2014, 1), None, {"future_dated_range"}),
        ([job("A", "x", [2013, 10], [2019, 1], False)], (2014, 1), 0.3, {"future_end_clamped"}),
    ],
)
def test_years(spark, posts, as_of, years, notes):
    p, got = one(spark, [("a.json#idx=0", "ats_json", None, posts)], as_of)
    assert p["years_experience"] == years and got == notes and len(p["experience"]) == len(posts)


def test_phone_second_pass(spark):
    raw = ("r.csv#row=1", "recruiter_csv", None, [("phones_raw", "06 12 34 56 78", "direct_field")])
    place = ("a.json#idx=0", "ats_json", None, [("location", {"city": "Lyon", "region": None, "country": "FR"}, "direct_field")])
    assert one(spark, [raw, place])[0]["phones"] == ["+33612345678"]
    p, notes = one(spark, [raw])
    assert p["phones"] == [] and notes == {"no_region_context"}
    assert one(spark, [("r.csv#row=1", "recruiter_csv", None, [("phones_raw", "+1 211 736 5000", "direct_field")])])[1] == {"invalid_number"}


def test_portfolio_and_ids(spark):
    links = lambda name, *urls: one(spark, [("n.txt#file", "notes_txt", None, [("full_name", name, "direct_field"), *[("links.other", u, "regex:url") for u in urls]])])[0]["links"]
    assert links("Orla Venngard", "https://www.venngard.example/cv", "https://forum.example/orla") == {"linkedin": None, "github": None, "portfolio": "https://www.venngard.example/cv", "other": ["https://forum.example/orla"]}
    assert links("Ola Ven", "https://olaven.example")["portfolio"] is None
    seeded = lambda seed: hashlib.sha256(seed.encode()).hexdigest()[:16]
    p, _ = one(spark, [("r.csv#row=1", "recruiter_csv", None, [("phones", "+33612345678", "direct_field"), ("emails", "o.venn+x@gmail.com", "direct_field"), ("emails", "z@inkpost.example", "direct_field")])])
    assert p["candidate_id"] == seeded("email:ovenn@gmail.com")
    p, _ = one(spark, [("l.json#profile", "linkedin_json", None, [("full_name", "Örla Venn", "direct_field"), job("Kite Labs", None, None, None, True)])])
    assert p["candidate_id"] == seeded("name+company:orla venn|kite labs")
    p, _ = one(spark, [("n.txt#file", "notes_txt", None, [("emails", "z@inkpost.example", "regex:e")])], flags=["multi_identity_source"])
    assert p["flags"] == ["multi_identity_source"] and p["candidate_id"] == seeded("record:c")


@pytest.mark.parametrize(("a", "b", "want"), [("Orla Venn", "venn, ö.", True), ("Zoë Åberg", "aberg zoe", True), ("Mira Solano", "Zed Zulu", False), ("", "X", True), ("Bo", "B", True), ("Bo Ek", "Ek-Dahl Ib", True), ("Bo", "Ib", False)])
def test_names(spark, a, b, want):
    x, y = identity.name_tokens(a), identity.name_tokens(b)
    assert identity.names_compatible(x, y) == identity.names_compatible(y, x) == want
    df = spark.createDataFrame([(x, y)], "a array<string>, b array<string>")
    assert df.select(identity.names_compatible_col(F.col("a"), F.col("b"))).first()[0] == want


def test_guarded_union_is_not_plain_components(spark):
    e = lambda name, *mails: [("full_name", name, "direct_field"), *[("emails", m, "direct_field") for m in mails]]
    a = atoms(spark, [
        ("a.csv#row=1", "recruiter_csv", None, e("Mira Solano", "shared@x.example")), ("a.csv#row=2", "recruiter_csv", None, e("Tom Reed", "shared@x.example", "tom@x.example")),
        ("a.csv#row=3", "recruiter_csv", None, e("T. Reed", "tom@x.example", "shared@x.example")), ("a.csv#row=10", "recruiter_csv", None, [("full_name", "Solo", "direct_field")]),
    ])
    who = identity.resolve(a)
    got = {r.cluster_id: (r.record_ids, r.match_keys_used) for r in who.clusters.collect()}
    assert got == {"a.csv#row=1": (["a.csv#row=1"], []), "a.csv#row=2": (["a.csv#row=2", "a.csv#row=3"], ["email:tom@x.example"]), "a.csv#row=10": (["a.csv#row=10"], [])}
    refused = sorted((r.records, r.key) for r in who.refusals.collect())
    assert refused == [(["a.csv#row=1", f"a.csv#row={n}"], "email:shared@x.example") for n in (2, 3)]


def test_grammar_of_lines():
    body = "Candidate - Orla Venn\nbased in: Lyon, France\nMSc in Baking Science, Venn Institute of Bread, 2009\nBaker at Kite Labs since Jun 2011.\nat nobody 1998 - 2003\nRivet Bank — Clerk\n(1998 to 2003)\nRivet — Clerk\n1998 to 2003 in the evenings\n"
    found = [(f.path, f.value, f.method, body[slice(*f.span)]) for f in read_text(body, Tools())]
    assert found == [
        ("full_name", "Orla Venn", "regex:labeled_name_v1", "Orla Venn"), ("location", {"city": "Lyon", "region": None, "country": "FR"}, "regex:labeled_location_v1", "Lyon, France"),
        ("education", {"institution": "Venn Institute of Bread", "degree": "MSc", "field": "Baking Science", "end_year": 2009}, "regex:education_line_v1", "MSc in Baking Science, Venn Institute of Bread, 2009"),
        ("experience", {"company": "Kite Labs", "title": "Baker", "start": (2011, 6), "end": None, "is_current": True, "summary": None}, "regex:experience_line_v1", "Baker at Kite Labs since Jun 2011."),
        ("experience", {"company": "Rivet Bank", "title": "Clerk", "start": (1998, None), "end": (2003, None), "is_current": False, "summary": None}, "regex:experience_block_v1", "Rivet Bank — Clerk\n(1998 to 2003)"),
    ]


def test_own_kinds_of_sources(spark, tmp_path):
    def cards(blob, out, tools):
        add = out.record("card")
        add("full_name", blob.decode().strip(), blob.decode())
        out.read = 1

    before = list(ADAPTERS)
    try:
        register(Adapter("card_txt", r"^card_.*\.txt$", cards), before="notes_txt")
        register(Adapter("notes_md", r"\.md$", cards))
        assert [a.kind for a in ADAPTERS].index("card_txt") < [a.kind for a in ADAPTERS].index("notes_txt")
        (tmp_path / "card_1.txt").write_text("Orla Venn")
        (tmp_path / "note.txt").write_text("Name: Bo Ek")
        (tmp_path / "x.md").write_text("Zed")
        got = scan(raw_files(spark, f"{tmp_path}/*"), shuffled=True)
        assert {(r.source_type, r.value) for r in got.atoms.collect()} == {("card_txt", "Orla Venn"), ("notes_txt", "Bo Ek"), ("notes_md", "Zed")}
        assert parse_file("x.md", "notes_md", b"Q", Tools())[0] == "ok"
    finally:
        ADAPTERS[:] = before


def test_documents_keep_to_their_schema(done):
    schema = json_schema(done.query)
    for d in done.documents():
        assert violations(d, schema) == []
    d = done.documents()[0]
    assert violations({k: v for k, v in d.items() if k != "candidate_id"}, schema) == ["/candidate_id: is required"]
    assert violations(d | {"emails": [1], "extra": 2}, schema) == ["/extra: isn't foreseen", "/emails/0: is no string"]
    nested = compile_query({"on_missing": "omit", "fields": [{"path": "who.name", "from": "full_name", "type": "string"}, {"path": "n", "from": "years_experience", "type": "number", "required": True}]})
    assert violations({"n": 1.5}, json_schema(nested)) == ["/who: is required"] and violations({"who": {}, "n": True}, json_schema(nested)) == ["/n: is no number"]


def test_events(done, caplog):
    from corrobora.plans import telemetry

    telemetry.log.propagate = True
    with caplog.at_level(logging.INFO, logger="corrobora.events"):
        telemetry.tell_run(done, 1.5)
    told = {r.getMessage(): getattr(r, "details", {}) for r in caplog.records}
    assert told["sources_read"] == {"ok": 9, "partial": 2, "skipped": 3} and told["unions_refused"] == {"suspect_shared_identifier": 2}
    assert told["run_done"]["milliseconds"] == 1500 and told["run_done"]["output"] == done.output_hash()
    line = telemetry.Lines(True).format(caplog.records[-1])
    assert json.loads(line)["event"] == "run_done" and "run_done" in telemetry.Lines(False).format(caplog.records[-1])


def test_tables_of_a_run_and_lookups(spark, done, folder, tmp_path):
    assert main(["run", "--input", f"file://{folder}/*", "--config", "recruiter_view", "--tables", str(tmp_path / "t")]) == 0
    assert spark.read.parquet(str(tmp_path / "t/records")).columns[0] == "candidate_key" and spark.read.parquet(str(tmp_path / "t/sources")).count() == 14
    who = identity.resolve(done.scan.atoms)
    pairs = {(r.cluster_id, r.other_id) for r in identity.refused_neighbours(who).collect()}
    assert pairs and pairs == {(b, a) for a, b in pairs}
    trace = merge.evidence_trace(done.scan.atoms, who.members)
    assert trace.count() == done.scan.atoms.count() and trace.where("strength <= 0").count() == 0


def test_planted_people(spark):
    """The generator's truth: everybody found who shares an address or a number, and no strangers merged, in any order."""
    ats, roster, truth = made_up(spark, 1200)
    atoms_ = ats_atoms(ats).unionByName(roster_atoms(roster))
    found = {r.record_id: r.cluster_id for r in identity.resolve(atoms_).members.collect()}
    people_ = {r.record_id: r.person for r in truth.collect()}
    assert found.keys() == people_.keys()
    by = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert by(found) == by(people_) and len(by(people_)) < len(people_)
    again = {r.record_id: r.cluster_id for r in identity.resolve(atoms_.repartition(5, F.rand(3))).members.collect()}
    assert again == found


def test_dictionaries_are_checked(tmp_path):
    from corrobora.functions.dictionaries import checksum, load_aliases

    f = tmp_path / "a.json"
    f.write_text(json.dumps({"version": "1", "aliases": {"golang": "go", "k8s": "kubernetes"}}))
    sum_ = checksum({"k8s": "kubernetes", "golang": "go"})
    assert load_aliases(f, sum_) == {"golang": "go", "k8s": "kubernetes"}
    with pytest.raises(ValueError, match="have changed"):
        load_aliases(f, "0" * 64)
    f.write_text(json.dumps({"golang": 1}))
    with pytest.raises(ValueError, match="must be texts"):
        load_aliases(f)
