"""Token ids, leaks and text quality."""

import os

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from corrobora.llm import leaks, measures, quality, tokens

have = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def encoders():
    import tiktoken

    lines = open(tokens.VOCABULARY, "rb").read()
    e = tokens.TrieEncoder(lines)
    return e, tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=e.rank, special_tokens={})


def by_trie(e, text):
    words = regex.findall(tokens.PATTERN, text)
    known = e.encode([w.encode() for w in words])
    return [i for w in words for i in known[w.encode()]]


@have
@settings(max_examples=150, deadline=None)
@given(st.text(max_size=120))
def test_any_text_as_the_public_encoder(encoders, text):
    assert by_trie(encoders[0], text) == encoders[1].encode_ordinary(text)


@have
def test_hard_texts(encoders):
    for text in ["<|endoftext|> x", "a" * 20_000, " \n\n  x\t y ", "I'll 've we'RE", "日本語のテキスト", "é" * 50, "-" * 3000, "".join(map(chr, range(32, 600)))]:
        assert by_trie(encoders[0], text) == encoders[1].encode_ordinary(text)


@have
def test_shared_prefixes_are_encoded_once(encoders):
    e = tokens.TrieEncoder(open(tokens.VOCABULARY, "rb").read())
    calls = []
    state = e.state
    e.state = lambda w, d, s: calls.append(w[:d]) or state(w, d, s)
    e.encode([b"interview", b"interviews", b"interviewer", b"inter"])
    assert len(calls) == len(set(calls)) == len(b"interviewer") + 1


@have
def test_ids_operator(spark):
    df = spark.createDataFrame([(1, "Hello world", [0]), (2, None, [0]), (3, "", [0]), (3, "", [0]), (None, "Hello", [0])], "doc_id bigint, text string, ids array<int>")
    got = sorted((r.doc_id or 0, r.ids) for r in tokens.token_ids(df).collect())
    assert got == [(0, [15496]), (1, [15496, 995]), (2, []), (3, []), (3, [])]
    assert tokens.token_ids(df.limit(0)).count() == 0


ITEM = "Nominee Cegald swapped surname racri for Benov following registry decree 2018. Between fiwyn and soquo, only one resume mentions apprenticeship Vidun under guild 5799."
OTHER = "Contract Zutol obliges Cequo to disclose every alias used since 8605 near haald before any transfer of open vacancies holding dossiers."


def found(spark, docs, items=((1, ITEM), (2, OTHER), (3, "too short"), (4, None)), kind="verbatim"):
    d = spark.createDataFrame([(i, t, "k") for i, t in docs], "doc_id bigint, text string, item_id string")
    e = spark.createDataFrame([(i, t, "task", "test") for i, t in items], "item_id bigint, text string, task string, split_name string")
    return sorted((r.doc_id, r.item_id, r.run_words) for r in leaks.leaked_items(d, e).where(f"kind = '{kind}'").collect())


def test_leaks_in_any_layout(spark):
    w = ITEM.split()
    docs = {
        1: f"Some prose. {ITEM} More prose.", 2: ITEM.upper().replace(",", ""), 3: "<p>" + "</p><p>".join(f"<b>{x}</b>" if i % 3 else x for i, x in enumerate(w)) + "</p>", 4: "&nbsp;".join(w),
        5: ITEM.replace("registry", "regis-\ntry").replace("surname", "sur-\r\nname"), 6: " ".join(w[:6]) + " [page 2] " + " ".join(w[6:12]), 7: "\n".join(f"{i + 1}. {' '.join(w[i * 4 : i * 4 + 4])}" for i in range(6)),
        8: " | ".join(w[:10]), 9: " ".join(w[:9]), 10: " ".join(w[:9]) + " odd " + " ".join(w[9:17]), 11: " ".join(sorted(w)), 12: None, 13: "", 14: f"{' '.join(w[3:14])} {OTHER}", 15: "prose " * 30_000 + " ".join(w[5:16]),
    }
    got = found(spark, docs.items())
    assert {(d, i) for d, i, _ in got} == {(d, 1) for d in (1, 2, 3, 4, 5, 6, 7, 8, 14, 15)} | {(14, 2)}
    assert {d: n for d, i, n in got if i == 1}[8] == 10


def test_no_items_or_documents(spark):
    assert found(spark, []) == [] and found(spark, [(1, ITEM)], []) == [] and found(spark, [(1, ITEM)], [(9, "a b c")]) == []


def test_repeats_and_brute_force(spark):
    import random

    rnd = random.Random(2)
    words = [f"w{i}" for i in range(30)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(25))) for i in range(8)]
    docs = []
    for i in range(40):
        base = [rnd.choice(words) for _ in range(40)]
        src = rnd.choice(items)[1].split()
        n = rnd.randrange(6, 15)
        a = rnd.randrange(0, 25 - n)
        base[10 : 10 + n] = src[a : a + n]
        docs.append((i, " ".join(base)))
    docs.append(docs[0])
    grams = {i: {tuple(t.split()[k : k + 10]) for k in range(16)} for i, t in items}
    want = sorted((d, i) for d, t in docs for i, g in grams.items() if any(tuple(t.split()[k : k + 10]) in g for k in range(31)))
    assert [(d, i) for d, i, _ in found(spark, docs, items)] == want and want


def test_common_order_by_brute_force():
    import random

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            out = [0]
            for j, y in enumerate(b):
                out.append(row[j] + 1 if x == y and x >= 0 else max(out[-1], row[j + 1]))
            row = out
        return row[-1]

    rnd = random.Random(5)
    a = [[rnd.randrange(-1, 5) for _ in range(7)] for _ in range(200)]
    b = [[rnd.randrange(-2, 5) for _ in range(9)] for _ in range(200)]
    got = leaks.common_order(leaks.np.array(a), leaks.np.array(b)).tolist()
    assert got == [lcs(x, y) for x, y in zip(a, b)]


PARAPHRASES = {
    1: "Nominee Cegald swapped the surname racri for Benov under following registry decree, 2018. Prose goes on here.",
    2: "We know: between fiwyn and also soquo only one known resume ever mentions apprenticeship Vidun there under guild 5799.",
}
NO_PARAPHRASES = {
    3: "Nominee Anna swapped the surname Miller for Smith under following registry decree, 1999. Prose goes on here.",
    4: "decree registry following Benov racri surname swapped Cegald Nominee 2018 in a list of words turned round, with more words around it",
    5: "It took 32 weeks, but the desk was finished by October and mentions of apprenticeship were few.",
}


def test_paraphrases_by_order_and_answers(spark):
    docs = list((PARAPHRASES | NO_PARAPHRASES).items())
    assert {(d, i) for d, i, _ in found(spark, docs, kind="paraphrase")} == {(1, 1), (2, 1)}
    assert found(spark, docs) == []


@pytest.mark.parametrize(("name", "off"), [("COSINE", 1.5), ("IN_ORDER", 6), ("SAME_ORDER", 1.1), ("ANSWERS", 1.1)])
def test_every_step_decides(name, off, monkeypatch):
    """Planted leaks go missing when the similarity, the order of blocks, the order of passages or the answers are switched off."""
    items = leaks.Items([(1, ITEM), (2, OTHER)])
    rnd = leaks.np.random.default_rng(3)
    space = leaks.Space(items, leaks.np.ones(len(items.known), dtype="float32"), leaks.np.linalg.qr(rnd.standard_normal((len(items.known), 16)))[0])
    texts = [*PARAPHRASES.values(), ITEM]
    want = [(0, 1, "paraphrase"), (1, 1, "paraphrase"), (2, 1, "verbatim")]
    assert [x[:3] for x in leaks.search(texts, space)] == want
    monkeypatch.setattr(leaks, name, off)
    assert [x[:3] for x in leaks.search(texts, space)] == ([] if name in ("COSINE", "IN_ORDER") else want[2:])


def test_nothing_near_means_nothing_found(monkeypatch):
    """The latent vectors choose the candidates: scrambled ones find no leak, not even a verbatim one."""
    items = leaks.Items([(1, ITEM)])
    space = leaks.Space(items, leaks.np.ones(len(items.known), dtype="float32"), leaks.np.linalg.qr(leaks.np.random.default_rng(3).standard_normal((len(items.known), 16)))[0])
    assert [x[2] for x in leaks.search([ITEM], space)] == ["verbatim"]
    space.rows = -space.rows
    assert leaks.search([ITEM], space) == []


def test_items_in_parts(spark, monkeypatch):
    monkeypatch.setattr(leaks, "MOST_BLOCKS", 25)
    docs = [(1, f"x {ITEM} y"), (2, OTHER), (3, f"{OTHER} {ITEM}")]
    assert {(d, i) for d, i, _ in found(spark, docs)} == {(1, 1), (2, 2), (3, 1), (3, 2)}


PROSE = "It took 32 weeks, but the desk was finished by October. References were direct, though 14 of them knew little about shift planning. Please send the shortlist to Anna at short notice."
LIST = "Skills\n" + "\n".join(f"• {x}" for x in ("kotlin", "python", "machine learning", "warehouse planning", "contract drafting", "go", "sql"))
TABLE = "ref\tyears\tcity\n" + "\n".join(f"R{i}123\t{i}\tAldfield" for i in range(8))
KINDS = {
    "prose": PROSE, "caps": PROSE.upper(), "nopunct": PROSE.lower().replace(",", "").replace(".", "\n"), "ja": "前回の面談では、彼は落ち着いて話しました。給与についても三十分ほど話し合いました。" * 3,
    "list": LIST, "dashes": LIST.replace("•", "1 -"), "inline": "go / sql / python / machine learning / kotlin / payroll processing / docker",
    "table": TABLE, "csv": TABLE.replace("\t", ","), "pipes": "\n".join("| " + " | ".join(r.split("\t")) + " |" for r in TABLE.split("\n")), "html": "<table>\n" + "\n".join(f"<tr><td>{i}</td><td>x</td></tr>" for i in range(5)) + "\n</table>",
    "fixed": "name            years  city\n" + "\n".join(f"Person {i:02d}       {i + 10}     Aldfield" for i in range(6)),
    "junk": "kVvkqjObZOW3CQtzCWMO61KFhNVw170yqHLd0AAXHeFPwC3rJgcqVaAUiamzN69ztS7VEA4oAO6\n" * 5, "hex": "f5 f6 4d fe ef b2 ba b6 19 3e 7d cc 00 34 b1 85 dd e3 07 59 e8 e9 7c 79", "again": "asdf " * 80, "rule": "-" * 200, "digits": "73 7 093.05.07--8 23699404.5009-79-0.721\n" * 6,
    "mash": "lzgmhmxn cjhwlrjcrv xxljjbxqqnngp nwttpltpfkx jlcplntj gpbhmxdjvrp zqqhrdfw", "soup": "!/#@_|=|?^|=!>^{$^&<<@&{~%~!*{<#$&=^=$~[[_=>^&~}![#}#^?{#!{[&#<|>*%#/}|=<_@[=|?/@@" * 3,
}


NONE = measures.np.zeros(0, dtype=measures.np.int64)


def test_measures_of_nothing_and_of_much():
    m = measures.measure([None, "", " \n "], NONE)
    assert all(set(m[k].tolist()) <= {0, 0.0} for k in measures.STATISTICS if k != "n_chars") and m["n_chars"].tolist() == [0, 0, 3]
    assert all(len(v) == 0 for v in measures.measure([], NONE).values())
    m = measures.measure([PROSE * 3000, PROSE], NONE)
    assert m["item_share"].tolist() == m["column_share"].tolist() == [0.0, 0.0] and m["n_words"][0] > 90_000


def test_measures_dont_depend_on_the_batch():
    texts = list(KINDS.values())
    together = measures.measure(texts, NONE)
    for i, t in enumerate(texts):
        assert {k: v[0] for k, v in measures.measure([t], NONE).items()} == {k: v[i] for k, v in together.items()}


def test_document_words_by_counting():
    texts = ["Alpha beta, alpha", "BETA x gamma", None, ""]
    w, n = measures.document_words(texts)
    assert sorted(n.tolist()) == [1, 1, 2] and list(w) == sorted(w)


def test_measures_agree_with_the_builtin_statistics(spark):
    rows = [(i, t, "en") for i, t in enumerate([*KINDS.values(), "a\r\nb.\rc\u3000d", "İx ß.", "“Quoted.”\n\n(x)"])]
    got = quality.text_statistics(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).orderBy("doc_id").collect()
    m = measures.measure([t for _, t, _ in rows], NONE)
    for name in ("n_chars", "n_words", "mean_word_length", "symbol_ratio"):
        assert [r[name] for r in got] == pytest.approx(m[name].tolist(), abs=2e-6), name


def test_quality_operator(spark):
    rows = [(i, PROSE.replace("32", str(i)), "en", 1.0) for i in range(60)] + [(100 + i, t, "EN-gb" if i % 2 else None, 1.0) for i, t in enumerate(KINDS.values())] + [(900, None, "en", 1.0), (901, " ", "en", 1.0), (902, "", None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, score double")
    got = {r.doc_id: r.kind for r in quality.non_prose(df).collect()}
    names = list(KINDS)
    want = {100 + i: k for k, ns in (("list", "list dashes inline"), ("table", "table csv pipes html fixed"), ("junk", "junk hex again rule digits mash soup")) for i, n in enumerate(names) if n in ns.split()}
    assert got == want
    assert quality.non_prose(df.limit(0)).count() == 0


def test_the_tails_decide(spark, monkeypatch):
    """Without the joint tails nothing is told apart: planted lists, tables and junk come out only by their ranks."""
    rows = [(i, PROSE.replace("32", str(i)), "en") for i in range(30)] + [(100 + i, t, "en") for i, t in enumerate(KINDS.values())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert quality.non_prose(df).count() == 15
    monkeypatch.setattr(quality, "_beyond", lambda share, pool: quality.F.lit(0.0))
    assert quality.non_prose(df).count() == len(rows)


def test_numbers_in_columns_are_a_table(spark):
    table = "\n".join(f"| {i}.4 | {2000 + i}-07 | R{i}93 |" for i in range(9))
    quoted = "\n".join(f'"{i}";"{i}.1";"2"' for i in range(9))
    rows = [(i, PROSE.replace("32", str(i)), "en") for i in range(30)] + [(50, table, "en"), (51, quoted, "en")]
    assert {r.doc_id: r.kind for r in quality.non_prose(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()} == {50: "table", 51: "table"}


def test_copies_that_fill_a_pool_are_kept(spark):
    rows = [(i, PROSE.replace("32", str(i)), "en") for i in range(60)] + [(100 + i, KINDS[("junk", "list", "table")[i // 90]], ("ja", "fr", None)[i // 90]) for i in range(270)]
    rows += [(500 + i, PROSE.replace("32", str(i)), ("ja", "fr", None)[i % 3]) for i in range(30)]
    got = {r.doc_id: (r.kind, r.score) for r in quality.non_prose(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).collect()}
    assert {i: k for i, (k, _) in got.items()} == {100 + i: ("junk", "list", "table")[i // 90] for i in range(270)}


def test_ranks_against_brute_force(spark):
    rows = [(i, "ab"[i % 3 == 0], float(i % 7 if i % 2 else 0)) for i in range(500)]
    df = spark.createDataFrame(rows, "doc_id bigint, g string, v double")
    got = {r.doc_id: (r.p_low, r.p_high) for r in quality.tail_ranks(df, "doc_id", "g", ["v"]).collect()}
    for i, g, v in rows:
        own = [x for _, h, x in rows if h == g]
        assert got[i] == (sum(x <= v for x in own) / len(own), sum(x >= v for x in own) / len(own))
