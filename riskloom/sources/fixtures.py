"""A small synthetic bank of two cores with known truth: duplicates, look-alikes, quality issues and money-movement
patterns. The same seed gives the same bytes."""

from __future__ import annotations

import random
import uuid
from datetime import date, datetime, timedelta

from riskloom.sources.files import write_csv

END = date(2026, 8, 31)
START = date(2026, 3, 1)
_FIRST = ["ROBERT", "WILLIAM", "ELIZABETH", "JAMES", "MARIA", "AISHA", "CHEN", "OLGA", "PAUL", "NINA", "OSCAR", "RUTH", "IVAN", "LENA", "HUGO", "CLARA"]
_NICK = {"ROBERT": "BOB", "WILLIAM": "BILL", "ELIZABETH": "LIZ", "JAMES": "JIM"}
_LAST = ["HARTLEY", "OKAFOR", "LINDQVIST", "MORALES", "BRANDT", "NAKAMURA", "DUBOIS", "KOWALSKI", "FERRARI", "SINGH", "OCONNOR", "PETROV", "ALMEIDA", "JANSEN", "WEAVER", "QUINN"]
_STREETS = ["Maple Street", "Oak Avenue", "River Road", "Hill Drive", "Lake Lane"]
_CITIES = [("Alder", "PA"), ("Birch", "OH"), ("Cedar", "NY")]


def generate(folder: str, seed: int = 7, people: int = 160, duplicates: int = 30) -> dict:
    """Writes the extracts; returns the manifest and the truth."""
    r = random.Random(seed)
    code = lambda n: "".join(r.choice("0123456789ABCDEF") for _ in range(n))
    uid = lambda: str(uuid.UUID(int=r.getrandbits(128), version=4))
    truth: dict = {"links": set(), "lookalikes": set(), "dq": {}, "patterns": {}}
    a_rows, b_rows, a_acc, b_acc, a_txn, b_txn, alerts, cases, kyc, a_loans, b_loans = ([] for _ in range(11))

    def person() -> dict:
        city, state = r.choice(_CITIES)
        return {"first": r.choice(_FIRST), "last": r.choice(_LAST) + r.choice(["", "SON", "MAN", "FIELD", "WORTH"]), "mid": r.choice("ABCDEFGH"), "sfx": "", "dob": date(1940, 1, 1) + timedelta(days=r.randrange(22000)), "token": code(16), "no": r.randint(1, 9999), "street": r.choice(_STREETS), "city": city, "state": state, "zip": f"{r.randint(10000, 99999)}", "phone": f"{r.randint(2000000000, 9899999999)}"}

    def to_a(p: dict) -> str:
        cif = f"{len(a_rows) + 100000001}"
        street = p["street"].replace(" Street", " ST").replace(" Avenue", " AVE").replace(" Road", " RD").replace(" Drive", " DR").replace(" Lane", " LN")
        a_rows.append({"CIF_NO": cif, "CUST_TYPE": "I", "FIRST_NM": p["first"], "MID_INIT": p["mid"], "LAST_NM": p["last"], "SFX": p["sfx"], "BIRTH_DT": p["dob"].strftime("%Y%m%d") if p["dob"] else "00000000", "TAX_ID_TKN": p["token"], "ADDR_LN1": f"{p['no']} {street}".upper(), "CITY": p["city"].upper(), "ST": p["state"], "ZIP5": p["zip"], "PHONE_NO": p["phone"]})
        return cif

    def to_b(p: dict) -> str:
        key = uid()
        name = f"{p['last']}, {p['first']}" + (f" {p['mid']}" if p["mid"] else "") + (f" {p['sfx']}" if p["sfx"] else "")
        t = p["phone"]
        b_rows.append({"party_uuid": key, "party_kind": "PERSON", "full_name": name, "dob": p["dob"].strftime("%m/%d/%Y") if p["dob"] else "", "ssn_token": "tkn_" + p["token"].lower() if p["token"] else "", "street": f"{p['no']} {p['street']}", "city_state_zip": f"{p['city']}, {p['state']} {p['zip']}", "phone_num": f"({t[:3]}) {t[3:6]}-{t[6:]}"})
        return key

    def account(core: str, owner: str, **more) -> str:
        if core == "a":
            no = f"{len(a_acc) + 5000000001}"
            a_acc.append({"ACCT_NO": no, "CIF_NO": owner, "PROD_CD": r.choice(["DDA", "SAV", "MMA", "CD"]), "BR_CD": f"{r.randint(1, 4):03d}", "OPEN_DT": "20150310", "ACCT_STAT": "A", "CUR_BAL_CENTS": str(r.randint(0, 5_000_000)), "INT_RATE_PCT": "0.250", **more})
            return no
        no = f"PB-{len(b_acc) + 10000001}"
        b_acc.append({"acct_ref": no, "party_uuid": owner, "product_name": r.choice(["Everyday Checking", "Statement Savings"]), "branch_name": r.choice(["North", "South"]), "opened_on": "2016-05-01", "acct_status": "OPEN", "ledger_balance": f"{r.randint(0, 50000)}.00", "rate_pct": "0.100", **more})
        return no

    def post(core: str, acc: str, at: datetime, kind: str, amount: float, ctr: bool = False) -> None:
        back = kind in ("WIRO", "ACHD", "CWDR", "CARD")
        if core == "a":
            a_txn.append({"TXN_ID": f"T{len(a_txn):08d}", "ACCT_NO": acc, "POST_DT": at.strftime("%Y%m%d"), "POST_TM": at.strftime("%H%M%S"), "TXN_CD": kind, "AMT_CENTS": str(round(amount * 100) * (-1 if back else 1)), "CHNL_CD": "BR", "BR_CD": "001", "CTR_FLG": "Y" if ctr else "N"})
        else:
            name = {"CDEP": "Cash Deposit", "WIRI": "Incoming Wire", "WIRO": "Outgoing Wire", "ACHD": "ACH Debit", "CARD": "Debit Card Purchase", "ACHC": "ACH Credit"}[kind]
            b_txn.append({"txn_uuid": uid(), "acct_ref": acc, "txn_timestamp": at.strftime("%Y-%m-%dT%H:%M:%S") + "-04:00", "amount": f"{amount:.2f}", "dr_cr": "D" if back else "C", "txn_type_desc": name, "channel_desc": "Teller", "branch_name": "North", "ctr_filed": "true" if ctr else "false"})

    def profile(core: str, ref: str, cash: int, work: str) -> None:
        kyc.append({"kyc_id": f"K{len(kyc):05d}", "core": core, "customer_ref": ref, "review_date": "2026-01-15", "risk_rating": "M", "occupation_or_business": work, "expected_monthly_cash_usd": str(cash), "expected_monthly_wires_usd": "0", "source_of_funds": "wages", "summary_text": "synthetic"})

    when = lambda day, hour=10: datetime.combine(day, datetime.min.time()) + timedelta(hours=hour)
    both = []
    for i in range(people):
        p = person()
        cif = to_a(p)
        acc = account("a", cif)
        for _ in range(r.randint(2, 8)):
            post("a", acc, when(START + timedelta(days=r.randrange(180)), r.randint(8, 17)), r.choice(["CARD", "ACHC", "CDEP"]), r.randint(10, 900))
        if i < duplicates:
            q = dict(p)
            if i % 3 == 1:  # a typo or a nickname, the token stays
                q["first"] = _NICK.get(q["first"], q["first"])
                q["last"] = q["last"][:-1] + "X" if r.random() < 0.5 else q["last"]
            elif i % 3 == 2:  # no token, but the same person by name, birth date and contact
                q["token"] = ""
            key = to_b(q)
            truth["links"].add((f"core_a:{cif}", f"core_b:{key}"))
            both.append((cif, key, acc, account("b", key)))
    for i in range(12):  # father and son, twins: must not be linked on their own
        p = person()
        cif = to_a(p | {"sfx": "SR"})
        q = p | {"token": code(16), "sfx": "JR", "dob": p["dob"] + timedelta(days=9000)} if i % 2 else p | {"token": code(16), "first": r.choice([f for f in _FIRST if f != p["first"]])}
        truth["lookalikes"].add((f"core_a:{cif}", f"core_b:{to_b(q)}"))
    for _ in range(60):
        account("b", to_b(person()))
    for rule, change in (("DQ_MISSING_DOB", {"dob": None}), ("DQ_FUTURE_DOB", {"dob": date(2029, 2, 3)}), ("DQ_INVALID_ZIP", {"zip": "1234"})):
        truth["dq"][rule] = {f"core_a:{to_a(person() | change)}" for _ in range(3)}
    a_acc.append(dict(a_acc[0]))
    truth["dq"]["DQ_DUPLICATE_KEY"] = {f"core_a:{a_acc[0]['ACCT_NO']}"}
    truth["dq"]["DQ_ORPHAN_ACCOUNT"] = {f"core_a:{account('a', '999999999')}", f"core_b:{account('b', uid())}"}
    for i, (cif, key, x, y) in enumerate(both[:6]):  # deposits just below the threshold, in both cores, on the same days
        for d in range(6):
            day = END - timedelta(days=2 + 4 * d)
            post("a", x, when(day), "CDEP", 9000 + 10 * i)
            post("b", y, when(day, 15), "CDEP", 8500)
        profile("core_a", cif, 1000, "clerk")
        profile("core_b", key, 1000, "clerk" if i % 2 else "trader")
        truth["patterns"][f"core_a:{cif}"] = {"XCORE_CASH_30D", "CTR_AGGREGATION_MISSED", "NEAR_THRESHOLD_CASH", "KYC_MISMATCH"} | (set() if i % 2 else {"KYC_INCONSISTENT_ACROSS_CORES"})
    for cif, key, x, _ in both[6:9]:  # money through in a day
        post("a", x, when(END - timedelta(days=40), 9), "WIRI", 60000)
        post("a", x, when(END - timedelta(days=39), 9), "WIRO", 57000)
        truth["patterns"][f"core_a:{cif}"] = {"RAPID_IN_OUT"}
    for cif, key, _, _ in both[9:12]:  # a sleeping account wakes
        acc = account("a", cif, ACCT_STAT="A", DORM_FLAG_DT="20240101", REACT_DT="20260601")
        post("a", acc, when(date(2026, 6, 10)), "ACHC", 15000)
        truth["patterns"][f"core_a:{cif}"] = {"DORMANT_REACTIVATION"}
    for cif, key, x, _ in both[12:15]:  # a cash business that said so
        for d in range(8):
            post("a", x, when(END - timedelta(days=1 + 3 * d)), "CDEP", 2500)
        profile("core_a", cif, 20000, "restaurant")
        truth["patterns"][f"core_a:{cif}"] = {"KYC_CONSISTENT_CASH"}
    for i, (cif, key, x, y) in enumerate(both[:20]):
        if i % 4 == 0:
            alerts.append({"ALERT_ID": f"AL{i:05d}", "CIF_NO": cif, "ACCT_NO": x, "RULE_CD": "STR02", "ALERT_DT": "20260820", "ALERT_SCORE": str(40 + i), "ALERT_STAT": "OPEN", "BR_CD": "001"})
        if i % 5 == 0:
            cases.append({"case_ref": f"CS{i:05d}", "party_uuid": key, "acct_ref": y, "scenario_name": "Large Cash Activity", "created_at": "2026-08-01T10:00:00-04:00", "priority": "P1", "state": "CLOSED", "outcome": "NOT_SUSPICIOUS", "closed_at": "2026-08-09T10:00:00-04:00"})
    for i, (cif, key, _, _) in enumerate(both):
        kind = ["AUTO", "MORT", "CRE", "CI"][i % 4]
        a_loans.append({"LOAN_NO": f"L{i:06d}", "CIF_NO": cif, "LOAN_TYP": kind, "BR_CD": "002", "ORIG_DT": "20200105", "MAT_DT": "20300105", "ORIG_AMT_CENTS": str(90_000_00 + i), "CUR_PRIN_CENTS": str(70_000_00 + i), "INT_RATE_PCT": "5.125", "COLL_TYP": ["CRE-OFF", "CRE-MF"][i % 2] if kind == "CRE" else "", "OWNER_OCC_FLG": "N", "DPD": str(i * 7 % 130)})
        if i % 3 == 0:
            cre = i % 2 == 0
            b_loans.append({"note_number": f"N{i:06d}", "party_uuid": key, "product_name": "Commercial Real Estate" if cre else "Personal Loan", "branch_name": "South", "booked_on": "2021-03-04", "maturity_on": "2031-03-04", "original_amount": "250000.00", "principal_outstanding": "200000.50", "interest_rate_pct": "6.000", "collateral_desc": "Warehouse on Main St" if cre else "Office chair", "owner_occupied": "false", "days_delinquent": str(i * 5 % 120)})
    tables = {"core_a_customers": a_rows, "core_a_accounts": a_acc, "core_a_txns": a_txn, "core_a_aml_alerts": alerts, "core_b_party": b_rows, "core_b_deposit_account": b_acc, "core_b_txn": b_txn, "core_b_case_alert": cases, "doc_kyc_summaries": kyc, "core_a_loans": a_loans, "core_b_loan": b_loans}
    return {"manifest": [write_csv(folder, t, rows) for t, rows in tables.items()], "truth": truth}
