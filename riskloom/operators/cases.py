"""Case files: evidence, a narrative rendered from it alone, and an approval log of two people, checked by hashes."""

from __future__ import annotations

import hashlib
import json
import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.sources.files import append, plain

OUTPUTS = "output_id string, party_id string, author string, created_at string, evidence_json string, evidence_sha256 string, text_sha256 string"
DECISIONS = "output_id string, approver string, decision string, comment string, decided_at string, text_sha256 string"


def evidence(relations: dict[str, DataFrame], party_id: str) -> dict:
    """All that a narrative may say, of one party."""
    of = lambda name, *cols, order: plain(relations[name].where(F.col("party_id") == party_id).select(*cols).orderBy(*order))
    return {
        "party": of("party", "party_id", "display_name", "cores", "link_status", order=["party_id"]),
        "risk": of("risk_score", "score", "raw_score", "top_reasons", order=["score"]),
        "signals": of("risk_signal", "rule_code", "weight", "amount", "evidence", order=["rule_code"]),
        "cash": plain(relations["transaction"].where((F.col("party_id") == party_id) & (F.col("txn_type") == "CASH_DEPOSIT")).select("txn_id", "posted_date", "amount", "core", "source_file", "source_row").orderBy("posted_date", "txn_id")),
        "kyc": of("kyc_profile", "kyc_id", "occupation", "expected_cash", order=["kyc_id"]),
        "alerts": of("alert", "alert_id", "scenario", "status", order=["alert_id"]),
    }


def canonical_json(ev: dict) -> str:
    return json.dumps(ev, sort_keys=True, separators=(",", ":"), default=str)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def render(ev: dict, author: str, status: str = "DRAFT") -> str:
    """The same text for the same evidence; every figure is the evidence's."""
    party, risk = (ev[k][0] if ev[k] else {} for k in ("party", "risk"))
    total = sum(c["amount"] for c in ev["cash"])
    score = risk.get("score", 0.0)
    out = [f"# Case file: {party.get('display_name', 'unknown')} ({status})", f"Prepared by {author}", "## Subject", f"Party {party.get('party_id')}, {party.get('cores', 0)} core(s), {party.get('link_status')}."]
    out += ["## Risk", f"Score {score:g}; reasons: {risk.get('top_reasons') or 'none'}.", "## Signals", *[f"- {s['rule_code']} ({s['weight']:+g}): {s['evidence']}" for s in ev["signals"]]]
    out += ["## Cash", f"{len(ev['cash'])} deposits, ${total:,.2f}.", *[f"- {c['posted_date']} ${c['amount']:,.2f} [{c['source_file']}:{c['source_row']}]" for c in ev["cash"]]]
    out += ["## Profile", *[f"- {k['kyc_id']}: {k['occupation']}, expected ${k['expected_cash'] or 0:,.2f} a month" for k in ev["kyc"]]]
    out += ["## Recommendation", "Escalate for review." if score >= 70 else "Keep under observation."]
    return "\n".join(out) + "\n"


class CaseStore:
    """Append-only Parquet; a status is derived from the latest decision."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _rows(self, kind: str, schema: str, output_id: str) -> list[dict]:
        try:
            df = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}")
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise
        return [r.asDict() for r in df.where(F.col("output_id") == str(uuid.UUID(output_id))).collect()]

    def draft(self, relations: dict[str, DataFrame], party_id: str, author: str, at: datetime) -> str:
        ev = canonical_json(evidence(relations, party_id))
        text = render(json.loads(ev), author)
        row = (str(uuid.uuid4()), party_id, author, at.isoformat(), ev, sha256(ev), sha256(text))
        append(self.spark.createDataFrame([row], OUTPUTS), f"{self.path}/outputs")
        return row[0]

    def text(self, output_id: str, status: str = "DRAFT") -> str:
        row = self._rows("outputs", OUTPUTS, output_id)[0]
        return render(json.loads(row["evidence_json"]), row["author"], status)

    def status(self, output_id: str) -> str:
        seen = self._rows("decisions", DECISIONS, output_id)
        return max(seen, key=lambda r: r["decided_at"])["decision"] if seen else "DRAFT"

    def decide(self, output_id: str, approver: str, decision: str, text: str, at: datetime, comment: str = "") -> None:
        row = self._rows("outputs", OUTPUTS, output_id)[0]
        if decision not in ("APPROVED", "REJECTED"):
            raise ValueError("a decision is APPROVED or REJECTED")
        if approver.strip().lower() == row["author"].strip().lower():
            raise PermissionError("the author can't decide")
        if self._rows("decisions", DECISIONS, output_id):
            raise ValueError("it has been decided")
        if sha256(text) != row["text_sha256"]:
            raise ValueError("the text isn't the one that was drafted")
        append(self.spark.createDataFrame([(output_id, approver, decision, comment, at.isoformat(), sha256(text))], DECISIONS), f"{self.path}/decisions")

    def reproduce(self, output_id: str) -> bool:
        """Whether evidence and text, made again from the stored evidence alone, have their stored hashes."""
        row = self._rows("outputs", OUTPUTS, output_id)[0]
        return sha256(row["evidence_json"]) == row["evidence_sha256"] and sha256(self.text(output_id)) == row["text_sha256"]
