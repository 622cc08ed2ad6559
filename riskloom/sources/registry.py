"""Source tables: path, columns in file order. All columns are text when they are read."""

from __future__ import annotations

from pyspark.sql import types as T

#: File of each extract and its header.
FILES = {
    "core_a_customers": ("core_a/customers.csv.gz", "CIF_NO CUST_TYPE FIRST_NM MID_INIT LAST_NM SFX BUS_NM BIRTH_DT TAX_ID_TKN ADDR_LN1 CITY ST ZIP5 PHONE_NO EMAIL_ADDR CUST_SINCE_DT RISK_RTG OCCUP_DESC HOME_BR_CD"),
    "core_a_accounts": ("core_a/accounts.csv.gz", "ACCT_NO CIF_NO PROD_CD BR_CD OPEN_DT CLOSE_DT ACCT_STAT DORM_FLAG_DT REACT_DT CUR_BAL_CENTS INT_RATE_PCT"),
    "core_a_loans": ("core_a/loans.csv.gz", "LOAN_NO CIF_NO LOAN_TYP BR_CD ORIG_DT MAT_DT ORIG_AMT_CENTS CUR_PRIN_CENTS INT_RATE_PCT COLL_TYP OWNER_OCC_FLG DPD"),
    "core_a_txns": ("core_a/transactions.csv.gz", "TXN_ID ACCT_NO POST_DT POST_TM TXN_CD AMT_CENTS CHNL_CD BR_CD CTR_FLG CPTY_NM CPTY_BANK"),
    "core_a_aml_alerts": ("core_a/aml_alerts.csv.gz", "ALERT_ID CIF_NO ACCT_NO RULE_CD ALERT_DT ALERT_SCORE ALERT_STAT DISPO_CD CLOSE_DT ASSIGNED_TO BR_CD"),
    "core_a_branches": ("core_a/branches.csv.gz", "BR_CD BR_NM CITY ST"),
    "core_a_control_totals": ("core_a/control_totals.csv.gz", "FILE_NM REC_CNT AMT_TOTAL_CENTS AS_OF_DT"),
    "core_b_party": ("core_b/party.csv.gz", "party_uuid party_kind full_name dob ssn_token street city_state_zip phone_num email_addr relationship_start kyc_risk employer_or_industry home_branch"),
    "core_b_deposit_account": ("core_b/deposit_account.csv.gz", "acct_ref party_uuid product_name branch_name opened_on closed_on acct_status dormant_since reactivated_on ledger_balance rate_pct"),
    "core_b_loan": ("core_b/loan.csv.gz", "note_number party_uuid product_name branch_name booked_on maturity_on original_amount principal_outstanding interest_rate_pct collateral_desc owner_occupied days_delinquent"),
    "core_b_txn": ("core_b/txn.csv.gz", "txn_uuid acct_ref txn_timestamp amount dr_cr txn_type_desc channel_desc branch_name ctr_filed counterparty counterparty_institution"),
    "core_b_case_alert": ("core_b/case_alert.csv.gz", "case_ref party_uuid acct_ref scenario_name created_at priority state outcome closed_at analyst"),
    "core_b_branch": ("core_b/branch.csv.gz", "branch_name branch_city branch_state opened_year"),
    "core_b_control_totals": ("core_b/control_totals.csv.gz", "file_name record_count amount_total as_of"),
    "core_c_customers": ("core_c/customers.csv.gz", "custId givenName familyName birthDate taxRef addressLine cityName stateCode postalCode mobile createdTs"),
    "core_c_accounts": ("core_c/accounts.csv.gz", "accountId custId accountType balanceAmt openedDate statusCode"),
    "core_c_postings": ("core_c/postings.csv.gz", "postingId accountId postedTs amt typeCode channel"),
    "doc_investigator_notes": ("documents/investigator_notes.csv.gz", "note_id core alert_ref customer_ref author created_at note_text"),
    "doc_kyc_summaries": ("documents/kyc_summaries.csv.gz", "kyc_id core customer_ref review_date risk_rating occupation_or_business expected_monthly_cash_usd expected_monthly_wires_usd source_of_funds summary_text"),
    "gt_person_map": ("ground_truth/person_map.csv.gz", "person_id core customer_ref record_role"),
    "gt_duplicate_links": ("ground_truth/duplicate_links.csv.gz", "person_id core_a_cif core_b_party_uuid tier variation"),
    "gt_lookalike_pairs": ("ground_truth/lookalike_pairs.csv.gz", "pair_id lookalike_type core_a_cif core_b_party_uuid person_id_a person_id_b core_b_token_missing"),
    "gt_injected_patterns": ("ground_truth/injected_patterns.csv.gz", "pattern_id pattern_type person_id cores customer_refs account_refs window_start window_end total_amount_usd expected_reason_codes legacy_alert_refs detail"),
    "gt_dq_issues": ("ground_truth/dq_issues.csv.gz", "issue_id rule_id source_system record_key field"),
}


def columns(table: str) -> list[str]:
    return FILES[table][1].split()


def schema(table: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns(table)])
