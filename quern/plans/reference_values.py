"""What the SQL twins of the reference queries hold to be right.

Fixed values throughout: they are the recorded data's rules, stated here once more
and apart from the operators' own modules, so that a slip in either shows as a
difference between a query and its twin.
"""

# words
LEGAL_NOISE = "limited ltd inc corp corporation llp pvt private".split()
NAME_NOISE = "limited ltd inc corp corporation llp pvt private co company".split()
PERPETUAL_TEXTS = ("none", "perpetual", "unknown", "since inception")
NUMERIC_WORDS = "revenue arr mrr ebitda income growth margin percentage count amount headcount price cost valuation".split()

# values: scale words, currency marks in order of precedence, percent marks, scales of extracted values in order
MULTIPLIERS = {
    "crore": 10_000_000.0, "crores": 10_000_000.0, "cr": 10_000_000.0, "lakh": 100_000.0, "lakhs": 100_000.0, "lac": 100_000.0, "lacs": 100_000.0,
    "trillion": 1_000_000_000_000.0, "tn": 1_000_000_000_000.0, "billion": 1_000_000_000.0, "billions": 1_000_000_000.0, "bn": 1_000_000_000.0,
    "million": 1_000_000.0, "millions": 1_000_000.0, "mn": 1_000_000.0, "thousand": 1_000.0, "k": 1_000.0,
}
CURRENCY_MARKS = (
    ("₹", "INR"), ("rs", "INR"), ("inr", "INR"), ("$", "USD"), ("usd", "USD"), ("€", "EUR"), ("eur", "EUR"), ("£", "GBP"), ("gbp", "GBP"), ("¥", "JPY"), ("jpy", "JPY"),
)
PERCENT_MARKS = ("%", "percent", "ratio")
EXTRACTED_SCALES = (
    ("crores?|cr", 10_000_000.0), ("lakhs?|l", 100_000.0), ("billion|bn|b", 1_000_000_000.0), ("million|mn|m", 1_000_000.0), ("thousand|k", 1_000.0),
)

# extraction: measures (pattern, attribute, unit), the number in a measure, labelled amounts and shares, charts
KPI_RULES = (
    (r"[>~]?[0-9]+(?:\.[0-9]+)?\s*(?:Bn|billion|Mn|million)?\s*(?:\([0-9]+\))?\s*\n?\s*Express parcel shipments[A-Za-z\s\n]*", "Express Parcel Volume", "PARCELS"),
    (r"(?:[0-9]{1,3}(?:,[0-9]{3})*|[0-9]+)\s*(?:\([0-9]+\))?\s*\n?\s*(?:Pin codes covered|pin codes)", "PIN Code Coverage", "PIN_CODES"),
    (r"[>~]?[0-9]+(?:\.[0-9]+)?\s*(?:Mn|million|K)?\s*tonnes\s*(?:\([0-9]+(?:,[0-9]+)?\))?\s*\n?\s*Part-truckload freight[A-Za-z\s\n]*", "PTL Freight Delivered", "TONNES"),
    (r"(?:[0-9]{1,3}(?:,[0-9]{3})*|[0-9]+)\s*(?:\([0-9]+(?:,[0-9]+)?\))?\s*\n?\s*(?:Workforce strength|employees|workforce)", "Workforce Strength", "COUNT"),
    (r"[0-9]+(?:\.[0-9]+)?\s*(?:Mn|million)?\s*Sq ft\s*(?:\([0-9]+\))?\s*\n?\s*Logistics area[A-Za-z\s\n]*", "Logistics Area Under Management", "SQ_FT"),
    (r"(?:[>~]?[0-9]{1,3}(?:,[0-9]{3})*|[0-9]+)\s*(?:\([0-9]+(?:,[0-9]+)?\))?\s*\n?\s*Active customers", "Active Customers", "COUNT"),
    (r"[0-9]+(?:\.[0-9]+)?\s*(?:Mn|million|Bn|billion|K)?\s*Express parcels shipped", "Express Parcel Volume", "PARCELS"),
    (r"(?:(?:₹|Rs\.?|INR|\$)\s*[0-9]+(?:\.[0-9]+)?|[0-9]{1,3}(?:,[0-9]{3})*)\s*(?:Mn|million|Cr|crore|crores|Bn|billion)?\s*Revenue from services", "Revenue from Services", "INR"),
    (r"(?:(?:₹|Rs\.?|INR|\$)\s*[0-9]+(?:\.[0-9]+)?|[0-9]{1,3}(?:,[0-9]{3})*)\s*(?:Mn|million|Cr|crore|crores|Bn|billion)?\s*EBITDA\b", "EBITDA", "INR"),
)
KPI_NUMBER = r"[>~]?[0-9]+(?:\.[0-9]+)?\s*(?:Bn|Mn|million|billion|K)?|[0-9]{1,3}(?:,[0-9]{3})*"
MONEY_RULE = (
    r"([A-Z][A-Za-z0-9\s,\(\)]{3,40}?)\s*(?:of|was|reached|grew to|aggregating to|is|stood at)\s*"
    r"((?:₹|Rs\.?|INR|\$)\s*[0-9]+(?:\.[0-9]+)?\s*(?:Cr|crore|crores|million|billion|Mn|Bn|Lakh|Lakhs|M|B)?|[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?\s*(?:million|Cr|crores|billion))"
)
PERCENT_RULE = r"([A-Z][A-Za-z0-9\s]{2,30}?)\s*(?:of|margin|growth|cagr|share)?\s*[:=]?\s*([0-9]+(?:\.[0-9]+)?\s*%)"
CHART_RULE = (
    r"(?:Chart|Graph|Figure|Plot|Infographic)\s*[:\-]?\s*([A-Za-z0-9\s,\(\)]{3,40}?)\s*(?:stood at|reached|was|grew to)?\s*"
    r"((?:₹|Rs\.?|INR|\$)\s*[0-9]+(?:\.[0-9]+)?\s*(?:Cr|crore|crores|million|billion|Mn|Bn|Lakh|Lakhs|M|B)?|[0-9]{1,3}(?:,[0-9]{3})*(?:\.[0-9]+)?\s*(?:million|Cr|crores|billion)?)"
)
MONEY_FALLBACK, CHART_FALLBACK, LONGEST_LABEL = "Financial Metric", "Visual Chart Metric", 35
SKIPPED_LABELS = ("table", "page", "section", "dated")
RUPEE_MARKS = ("₹", "Rs", "INR", "Cr")

# gate
CHART_QUOTE = "[Visual Chart]"
UNVERIFIED = "UNVERIFIED_SOURCE_QUOTE: Quote not found in page text"
NO_AXIS = "DEGENERATE_CHART_AXIS: Missing time horizon on graph legend or axis"
NO_HORIZON = "DEGENERATE_TEMPORAL_BOUND: Numeric claim lacks time horizon"

# reconciliation
CORROBORATION, CONTRADICTION, RECONCILED = "CASE_1_CORROBORATION", "CASE_2_GENUINE_CONTRADICTION", "CASE_3_CONTEXT_RECONCILED"
CONFLICT = "Value Conflict"
AGGREGATION = "Aggregation Scope (Quarterly sub-period vs Full Fiscal Year)"
WHY = {
    "CASE_1_CORROBORATION": "Corroborated across documents: Identical values asserted under the same temporal interval and scope despite differing phrasing.",
    "CASE_2_GENUINE_CONTRADICTION": "Genuine contradiction: Mutually exclusive figures reported for the exact same reporting period and corporate scope.",
    "CASE_3_CONTEXT_RECONCILED": "Apparent contradiction reconciled by context: Figures differ due to ",
}
