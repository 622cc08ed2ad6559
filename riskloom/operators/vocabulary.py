"""Code vocabularies of the source systems. A code that isn't listed becomes NULL."""

PRODUCT_A = {"DDA": "CHECKING", "SAV": "SAVINGS", "MMA": "MONEY_MARKET", "CD": "CERTIFICATE"}
PRODUCT_B = {"Everyday Checking": "CHECKING", "Business Checking": "CHECKING", "Statement Savings": "SAVINGS", "Money Market": "MONEY_MARKET", "Certificate of Deposit": "CERTIFICATE"}
ACCOUNT_STATUS_A = {"A": "OPEN", "D": "DORMANT", "C": "CLOSED"}
LOAN_A = {"MORT": "MORTGAGE", "PERS": "PERSONAL", "CI": "C_AND_I"}  # others pass through
LOAN_B = {"Auto Loan": "AUTO", "Residential Mortgage": "MORTGAGE", "Home Equity Line": "HELOC", "Personal Loan": "PERSONAL", "Commercial Real Estate": "CRE", "Commercial & Industrial": "C_AND_I"}
COLLATERAL_A = {"CRE-OFF": "OFFICE", "CRE-RET": "RETAIL", "CRE-MF": "MULTIFAMILY", "CRE-IND": "INDUSTRIAL", "CRE-CON": "CONSTRUCTION"}
COLLATERAL_B = {"Office": "OFFICE", "Retail": "RETAIL", "Apartment": "MULTIFAMILY", "Warehouse": "INDUSTRIAL", "Construction": "CONSTRUCTION"}  # by how the description starts
TXN_A = {"CDEP": "CASH_DEPOSIT", "CWDR": "CASH_WITHDRAWAL", "ATMW": "ATM_WITHDRAWAL", "ACHC": "ACH_CREDIT", "ACHD": "ACH_DEBIT", "WIRI": "WIRE_IN", "WIRO": "WIRE_OUT", "CHKP": "CHECK_PAID", "CARD": "CARD_PURCHASE", "XFRI": "TRANSFER_IN", "XFRO": "TRANSFER_OUT", "INTC": "INTEREST"}
TXN_B = {"Cash Deposit": "CASH_DEPOSIT", "Cash Withdrawal": "CASH_WITHDRAWAL", "ATM Withdrawal": "ATM_WITHDRAWAL", "ACH Credit": "ACH_CREDIT", "ACH Debit": "ACH_DEBIT", "Incoming Wire": "WIRE_IN", "Outgoing Wire": "WIRE_OUT", "Check Paid": "CHECK_PAID", "Debit Card Purchase": "CARD_PURCHASE", "Transfer In": "TRANSFER_IN", "Transfer Out": "TRANSFER_OUT", "Interest Credit": "INTEREST"}
CHANNEL_A = {"BR": "BRANCH", "ATM": "ATM", "OLB": "ONLINE", "MOB": "MOBILE", "SYS": "SYSTEM"}
CHANNEL_B = {"Teller": "BRANCH", "ATM": "ATM", "Online Banking": "ONLINE", "Mobile App": "MOBILE", "System": "SYSTEM"}
SCENARIO_A = {"LCT01": "LARGE_CASH", "STR02": "STRUCTURING", "VEL03": "VELOCITY", "WIR04": "HIGH_RISK_WIRE", "RMV05": "RAPID_MOVEMENT", "DRM06": "DORMANT_ACTIVITY"}
SCENARIO_B = {"Large Cash Activity": "LARGE_CASH", "Possible Structuring": "STRUCTURING", "High Velocity": "VELOCITY", "High Risk Geography Wire": "HIGH_RISK_WIRE", "Rapid Movement of Funds": "RAPID_MOVEMENT", "Dormant Account Activity": "DORMANT_ACTIVITY"}
ALERT_STATUS_A = {"OPEN": "OPEN", "WIP": "IN_PROGRESS", "CLOSED": "CLOSED"}
ALERT_STATUS_B = {"NEW": "OPEN", "IN_REVIEW": "IN_PROGRESS", "ESCALATED": "IN_PROGRESS", "CLOSED": "CLOSED"}
DISPOSITION_A = {"FP": "FALSE_POSITIVE", "NSR": "NO_SAR_AFTER_REVIEW", "SAR": "SAR_FILED"}
DISPOSITION_B = {"NOT_SUSPICIOUS": "FALSE_POSITIVE", "NO_SAR_AFTER_REVIEW": "NO_SAR_AFTER_REVIEW", "SAR_FILED": "SAR_FILED"}
PRIORITY_SCORE = {"P1": 90, "P2": 75}  # others 50

#: Rule codes and their weights; negative ones mitigate.
RULES = {"XCORE_CASH_30D": 35, "CTR_AGGREGATION_MISSED": 30, "RAPID_IN_OUT": 25, "NEAR_THRESHOLD_CASH": 20, "DORMANT_REACTIVATION": 20, "KYC_MISMATCH": 15, "KYC_INCONSISTENT_ACROSS_CORES": 10, "KYC_CONSISTENT_CASH": -20}
