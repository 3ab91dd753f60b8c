"""Vocabularies and defaults.

Everything in this module is a fixed value: the word lists, maps and header
spellings decide the results and are therefore stated literally.
"""

from __future__ import annotations

UNKNOWN = "unknown"
NUMERIC_FILL = 0.0
CURRENCY_SYMBOL = "₹"

# Characters that count as white space when text is stripped.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Cell texts that a CSV scan reads as null.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# --- headers: canonical column -> accepted spellings, first match wins.
# Matching ignores case and outer spaces; `*` stands for any one word.
DEAL_HEADERS = {
    "deal_name": ["Deal Name", "item_name"],
    "owner_code": ["Owner code"],
    "client_code": ["Client Code"],
    "deal_status": ["Deal Status"],
    "close_date": ["Close Date (A)", "Close Date"],
    "closure_probability": ["Closure Probability"],
    "deal_value": ["Masked Deal value", "Deal Value"],
    "tentative_close_date": ["Tentative Close Date"],
    "deal_stage": ["Deal Stage"],
    "product_deal": ["Product deal"],
    "sector": ["Sector/service", "Sector"],
    "created_date": ["Created Date"],
}

WORK_ORDER_HEADERS = {
    "deal_name": ["Deal name masked", "item_name"],
    "customer_code": ["Customer Name Code"],
    "serial": ["Serial #"],
    "nature_of_work": ["Nature of Work"],
    "execution_status": ["Execution Status"],
    "sector": ["Sector"],
    "type_of_work": ["Type of Work"],
    "amount_total": [
        "Amount in Rupees (Excl of GST) (Masked)",
        "Amount in Rupees (Excl of GST.) (Masked)",
    ],
    "billed_value": [
        "Billed Value in Rupees (Masked)",
        "Billed Value in Rupees (Excl of GST.) (Masked)",
    ],
    "collected_amount": [
        "Collected Amount in Rupees",
        "Collected Amount in Rupees (Incl of GST.) (Masked)",
    ],
    "amount_to_be_billed": [
        "Amount to be billed",
        "Amount to be billed in Rs. (Exl. of GST) (Masked)",
    ],
    "amount_receivable": ["Amount Receivable", "Amount Receivable (Masked)"],
    "invoice_status": ["Invoice Status"],
    "expected_billing_month": ["Expected Billing Month"],
    "actual_billing_month": ["Actual Billing Month"],
    "wo_status": ["WO Status (billed)"],
    "collection_status": ["Collection status"],
    "billing_status": ["Billing Status"],
    "probable_start_date": ["Probable Start Date"],
    "probable_end_date": ["Probable End Date"],
    "date_po_loi": ["Date of PO/LOI"],
    "bd_personnel": ["BD/KAM Personnel code"],
    "last_invoice_date": ["Last invoice date"],
    "software_platform": [
        "Is any * software platform part of the contract",
        "Is any * software platform part of the client deliverables in this deal?",
    ],
}

DEAL_KEYS = ["deal_name", "client_code", "deal_value"]
DEAL_DATES = ["close_date", "tentative_close_date", "created_date"]
DEAL_MONEY = ["deal_value"]
DEAL_CATEGORICALS = [
    "deal_status", "deal_stage", "product_deal", "owner_code", "client_code",
]
# A deals row whose status cell repeats its own header is a stray header row.
DEAL_STATUS_HEADERS = ["Deal Status", "deal_status"]

WORK_ORDER_KEYS = ["deal_name", "serial", "amount_total"]
WORK_ORDER_DATES = [
    "probable_start_date", "probable_end_date", "date_po_loi", "last_invoice_date",
]
WORK_ORDER_MONEY = [
    "amount_total", "billed_value", "collected_amount", "amount_to_be_billed",
    "amount_receivable",
]
WORK_ORDER_CATEGORICALS = [
    "nature_of_work", "type_of_work", "invoice_status", "wo_status",
    "collection_status", "billing_status",
]

# --- value vocabularies
SECTOR_ALIASES = {
    "energy": "energy",
    "energy sector": "energy",
    "mining": "mining",
    "mining sector": "mining",
    "renewables": "renewables",
    "renewable": "renewables",
    "renewable energy": "renewables",
    "powerline": "powerline",
    "power line": "powerline",
    "railways": "railways",
    "railway": "railways",
    "rail": "railways",
    "construction": "construction",
    "dsp": "dsp",
    "tender": "tender",
    "others": "others",
    "other": "others",
    "security and surveillance": "security_and_surveillance",
    "manufacturing": "manufacturing",
    "aviation": "aviation",
}

DEAL_STATUSES = {
    "open": "Open",
    "dead": "Dead",
    "won": "Won",
    "on hold": "On Hold",
    "lost": "Lost",
    "closed": "Won",
    "active": "Open",
    "inactive": "Dead",
}

PROBABILITIES = {"high": "High", "medium": "Medium", "low": "Low"}

EXECUTION_STATUSES = {
    "completed": "Completed",
    "done": "Completed",
    "ongoing": "Ongoing",
    "in progress": "Ongoing",
    "not started": "Not Started",
    "pending": "Not Started",
}
EXECUTED_UNTIL_PREFIX = "executed until"
EXECUTED_UNTIL = "Executed until current"

DEAL_STAGES = [
    "A. Lead Generated",
    "B. Sales Qualified Leads",
    "C. Demo Done",
    "D. Feasibility",
    "E. Proposal/Commercials Sent",
    "F. Negotiations",
    "G. Project Won",
    "H. Work Order Received",
    "I. POC",
    "J. Invoice sent",
    "K. Amount Accrued",
    "L. Project Lost",
    "M. Projects On Hold",
    "N. Not relevant at the moment",
    "O. Not Relevant at all",
    "Project Completed",
]
NEGOTIATION_STAGE = "F. Negotiations"

ACTIVE_WO_STATUSES = ["Open", "open", "unknown"]
# "Executed until current month" never comes out of cleaning (see EXECUTED_UNTIL),
# so those orders do not count as active. Kept as it is.
ACTIVE_EXECUTION_STATUSES = [
    "Ongoing", "Not Started", "Executed until current month",
    "Partial Completed", "Pause / struck", "Details pending from Client",
]

# --- questions
METRICS = [
    "pipeline_value", "pipeline_by_sector", "pipeline_by_stage",
    "deals_closing_soon", "average_deal_size", "active_deals", "deal_trends",
    "work_orders_by_sector", "execution_status", "billing_completion_rate",
    "total_billed", "total_collected", "receivables", "billing_vs_collection",
    "financial_summary", "leadership_update",
]
PERIODS = ["current_month", "current_quarter", "all_time"]
MIN_QUESTION_LENGTH = 3
GIBBERISH_PATTERNS = [
    r"^[^a-zA-Z]*$",
    r"^(.)\1{4,}$",
    r"^[a-z]{1,2}$",
    r"(?U)^[^aeiouAEIOU\s]{6,}$",
]
SUGGESTED_QUESTIONS = [
    "How is our pipeline looking for the mining sector this quarter?",
    "What deals are likely to close this month?",
    "Which sectors generate the most revenue?",
    "How much receivable revenue do we have?",
    "What is the billing completion rate?",
    "Show me pipeline by deal stage",
    "Give me a leadership update",
]
INTENT_FIELDS = ["metric", "sector", "period", "status_filter", "description"]
DEFAULT_METRIC = "general_query"
NONSENSICAL_METRIC = "nonsensical"
