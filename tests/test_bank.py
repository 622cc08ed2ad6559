"""The bank from extracts to queue, against the generator's truth."""

import pytest

from riskloom.plans.bank import Params, build
from riskloom.sources.fixtures import generate


@pytest.fixture(scope="module")
def bank(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bank")
    made = generate(str(folder))
    return made, build(spark, str(folder), Params(), store=str(tmp_path_factory.mktemp("gold")))


def test_same_seed_same_bytes(tmp_path):
    a, b, c = (generate(str(tmp_path / x), seed=s)["manifest"] for x, s in (("a", 7), ("b", 7), ("c", 8)))
    assert a == b != c


def test_links_have_no_false_merge(bank):
    made, g = bank
    links = {(r.a_id, r.b_id) for r in g["auto_links"].collect()}
    truth = made["truth"]["links"]
    assert links <= truth
    assert len(links & truth) >= 0.95 * len(truth)
    assert not links & made["truth"]["lookalikes"]


def test_quality_exceptions_are_those_injected(bank):
    made, g = bank
    found = {}
    for r in g["dq_exceptions"].collect():
        found.setdefault(r.rule_id, set()).add(r.record_key)
    assert found == made["truth"]["dq"]


def test_patterns_fire(bank):
    made, g = bank
    party = {r.record_id: r.party_id for r in g["party_xref"].collect()}
    fired = {}
    for r in g["risk_signal"].collect():
        assert r.evidence
        fired.setdefault(r.party_id, set()).add(r.rule_code)
    for record, codes in made["truth"]["patterns"].items():
        assert codes <= fired.get(party[record], set()), record


def test_scores_and_queue(bank):
    made, g = bank
    weights = {}
    for r in g["risk_signal"].collect():
        weights.setdefault(r.party_id, []).append(r.weight)
    score = {r.party_id: r for r in g["risk_score"].collect()}
    assert {p: max(0, min(100, sum(w))) for p, w in weights.items()} == {p: r.score for p, r in score.items()}
    queue = sorted(g["alert_queue"].collect(), key=lambda r: r.queue_rank)
    assert [r.queue_rank for r in queue] == list(range(1, len(queue) + 1)) and {r.queue_size for r in queue} == {len(queue)}
    assert [r.priority for r in queue] == sorted((r.priority for r in queue), reverse=True)
    party = {r.record_id: r.party_id for r in g["party_xref"].collect()}
    structurers = {party[k] for k, v in made["truth"]["patterns"].items() if "XCORE_CASH_30D" in v}
    assert {r.party_id for r in queue[: len(structurers)]} == structurers


def test_canonical_rows_parse_and_keep_lineage(bank):
    _, g = bank
    for name in ("account", "transaction", "alert", "kyc_profile"):
        assert g[name].where("source_file IS NULL OR source_row IS NULL").count() == 0
    assert g["transaction"].where("posted_at IS NULL OR txn_type IS NULL OR amount < 0").count() == 0
    assert g["account"].count() == g["account"].select("account_id").distinct().count()


def test_loans_decode(bank):
    _, g = bank
    assert {r.loan_type for r in g["loan"].collect()} == {"AUTO", "MORTGAGE", "CRE", "C_AND_I", "PERSONAL"}
    assert g["loan"].where("(loan_type = 'CRE') <> (cre_category IS NOT NULL)").count() == 0
    assert g["loan"].where("party_id IS NULL OR principal_usd IS NULL OR days_past_due IS NULL").count() == 0


def test_raising_a_threshold_silences_its_rule(spark, bank, tmp_path):
    from riskloom.plans.bank import signals

    _, g = bank
    quiet = signals(spark, g["transaction"], g["account"], g["kyc_profile"], Params(cash_total=1e12))
    assert "XCORE_CASH_30D" not in {r.rule_code for r in quiet.collect()}
