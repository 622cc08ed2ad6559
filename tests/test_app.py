"""Catalogue, matcher, router, case files, onboarding, sources, search and streaming."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from riskloom.functions.similarity import jaro_winkler
from riskloom.operators import cases, onboarding, questions, router, search
from riskloom.plans.bank import Params, build
from riskloom.sources import files
from riskloom.sources.fixtures import generate
from riskloom.streaming.cash import windowed_cash


@pytest.fixture(scope="module")
def gold(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bank2")
    generate(str(folder), people=60, duplicates=20)
    return build(spark, str(folder), Params(), store=str(tmp_path_factory.mktemp("gold2")))


def test_every_question_answers(gold):
    for q in questions.catalogue():
        rows, said = questions.run(q, gold)
        assert said and "{" not in said
        assert rows or q.id in ("G06",)


def test_matcher_finds_rewordings_and_declines():
    m = questions.Matcher(questions.catalogue())
    for text, want in (("how many unique customers after matching", "G02"), ("false positive rate of alerts", "G04"), ("dormant accounts count", "G12"), ("days to close an alert", "G14"), ("missed currency report days", "D02"), ("what to work on first", "D03")):
        assert m.match(text)[0] == want, text
    for text in ("weather tomorrow", "hello", "tell me a joke about customers"):
        assert m.match(text)[0] is None, text
    with pytest.raises(ValueError):
        questions.Matcher(questions.catalogue()[:1] * 2)


def test_router(gold):
    m = questions.Matcher(questions.catalogue())
    who = gold["party"].where("cores = 2").orderBy("party_id").first()
    name = who.display_name.title()
    assert router.route(f"draft a narrative for {name}", gold["party"], m).kind == "NARRATIVE"
    assert router.route("How many accounts are dormant?", gold["party"], m).target == "G12"
    assert router.route("what does the policy section say on cash", gold["party"], m).kind == "SEARCH"
    found = router.route(f"show me {name}", gold["party"], m)
    assert found.kind == "CUSTOMER" and found.target in {r.party_id for r in gold["party"].where(F.col("display_name") == who.display_name).collect()}
    assert router.route("hm", gold["party"], m).kind == "CLARIFY"
    assert router.find_customers(gold["party"], "x' OR '1'='1") == []


def test_case_life(spark, gold, tmp_path):
    party = gold["risk_score"].orderBy(F.desc("score"), "party_id").first().party_id
    store = cases.CaseStore(spark, str(tmp_path))
    one = store.draft(gold, party, "ann", datetime(2026, 9, 1))
    text = store.text(one)
    assert "Escalate" in text and store.status(one) == "DRAFT" and store.reproduce(one)
    for who, what, said, kind in ((" ANN ", "APPROVED", text, PermissionError), ("bob", "MAYBE", text, ValueError), ("bob", "APPROVED", text + "x", ValueError)):
        with pytest.raises(kind):
            store.decide(one, who, what, said, datetime(2026, 9, 2))
    store.decide(one, "bob", "APPROVED", text, datetime(2026, 9, 2))
    assert store.status(one) == "APPROVED"
    with pytest.raises(ValueError):
        store.decide(one, "eve", "REJECTED", text, datetime(2026, 9, 3))


def test_onboarding_maps_an_unseen_core(spark):
    rows = [(f"C{i:05d}", "Ann", "Lee", "1980/02/03", f"{i:04d}-AAAA-BBBB-CCCC-DD", "1 Oak Rd", "Alder", "PA", "12345", "+1 555 010 9999", "1700000000", "f", i) for i in range(30)]
    names = "custId givenName familyName birthDate taxRef addressLine cityName stateCode postalCode mobile createdTs".split()
    raw = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names) + ", source_file string, source_row long")
    m = onboarding.map_file(raw, names)
    assert m.entity == "customer"
    want = {"customer_id": "custId", "first_name": "givenName", "last_name": "familyName", "birth_date": "birthDate", "token": "taxRef", "zip": "postalCode", "phone": "mobile", "state": "stateCode"}
    assert m.columns == want
    view = onboarding.canonical_view(raw, m)
    first = view.orderBy("source_row").first()
    assert (str(first.birth_date), first.phone, first.zip, first.token) == ("1980-02-03", "5550109999", "12345", "0000aaaabbbbccccdd")
    got = onboarding.checks(raw, view, m).first().asDict()
    assert got["rows"] == 30 and sum(v for k, v in got.items() if k != "rows") == 0
    acc = spark.createDataFrame([(f"A{i}", f"C{i:05d}", "CHK" if i % 2 else "ZZ") for i in range(30)], "accountId string, owner string, kind string")
    assert onboarding.discover_links(acc, ["accountId", "owner"], raw, "custId") == [("owner", 1.0)]
    _, review = onboarding.translate_codes(acc, "kind", {"CHK": "CHECKING"})
    assert review == ["ZZ"]
    assert onboarding.name_tokens("custGivenNM") == {"customer", "first", "name"}


def test_scan_keeps_lineage_and_refuses_other_headers(spark, tmp_path):
    rows = [{"BR_CD": "001", "BR_NM": 'A "B", C', "CITY": "", "ST": "PA"}, {"BR_CD": "002", "BR_NM": "x"}]
    files.write_csv(str(tmp_path), "core_a_branches", rows)
    got = files.scan(spark, str(tmp_path), "core_a_branches", "2026-01-01 00:00:00").orderBy("source_row").collect()
    assert [(r.BR_NM, r.CITY, r.source_row, r.source_file) for r in got] == [('A "B", C', None, 1, "core_a/branches.csv.gz"), ("x", None, 2, "core_a/branches.csv.gz")]
    with pytest.raises(ValueError):
        files.write_csv(str(tmp_path), "core_a_branches", [{"NO": 1}])
    (tmp_path / "core_b").mkdir()
    (tmp_path / "core_b" / "branch.csv.gz").write_bytes((tmp_path / "core_a" / "branches.csv.gz").read_bytes())
    with pytest.raises(Exception, match="header"):
        files.scan(spark, str(tmp_path), "core_b_branch").collect()


def test_config_and_plain(spark):
    assert files.flatten({"a": {"b": 1, "c": {"d": "x"}}, "e": True}) == [("a.b", 1.0, "1"), ("a.c.d", None, "x"), ("e", None, "True")]
    df = spark.sql("SELECT 1.50BD AS X, DATE '2026-01-02' AS d, CAST(NULL AS STRING) AS n")
    assert files.plain(df) == [{"x": 1.5, "d": "2026-01-02", "n": None}]


def test_search_terms_and_snippet():
    assert search.terms("What are the Policies, for $10,000 wires?") == ["policy", "$10000", "wire"]
    assert search.stem("boxes") == "box" and search.stem("notes") == "note" and search.stem("ing") == "ing"
    assert search.snippet("Short. This part says what wires need to have. Other things are here as well.", ["wire"]) == "This part says what wires need to have."


def test_jaro_winkler():
    assert round(jaro_winkler("MARTHA", "MARHTA"), 4) == 0.9611
    assert jaro_winkler("", "A") == 0.0 and jaro_winkler("A", "A") == 1.0
    assert round(100 * jaro_winkler("KERR", "KEIR")) == 87


def test_stream_of_cash(spark, tmp_path):
    rows = [("2026-08-01 10:00:00", 1, "core_a", Decimal(100)), ("2026-08-02 10:00:00", 1, "core_b", Decimal(50)), ("2026-08-02 11:00:00", 2, "core_a", Decimal(500)), ("2026-09-30 00:00:00", 9, "core_a", Decimal(1)), ("2026-07-01 00:00:00", 1, "core_b", Decimal(999))]
    schema = "at timestamp, party_id long, core string, amount decimal(18,2)"
    for n, part in enumerate((rows[:4], rows[4:])):  # the last row is late
        df = spark.createDataFrame([(datetime.fromisoformat(a), *r) for a, *r in part], schema)
        df.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = windowed_cash(stream, "2 days", "2 days", over=120).writeStream.format("memory").queryName("cash_out").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.sql("SELECT party_id, n, total FROM cash_out").collect()
    assert [(r.party_id, r.n, r.total) for r in got] in ([], [(1, 2, Decimal("150.00"))])
    assert all(r.party_id == 1 for r in got)
