"""Word lists, patterns and regular expressions for mentions, relations and their context."""

# Mention word lists, (label, head words, optional tail words).
MENTION_WORDS = [
    ("FINANCIAL_METRIC", ["revenue", "income", "profit", "loss", "earnings", "expenses"], ["growth", "margin", "ratio", "rate"]),
    ("FINANCIAL_METRIC", ["ebitda", "roi", "roe", "roa", "eps", "pe"], []),
    ("ACCOUNT", ["cash", "accounts", "inventory", "assets", "liabilities"], ["receivable", "payable", "equity", "capital"]),
    ("TRANSACTION", ["purchase", "sale", "payment", "receipt", "transfer"], ["order", "invoice", "receipt", "transaction"]),
    ("MARKET", ["nyse", "nasdaq", "lse", "tsx", "asx"], []),
    ("INDUSTRY", ["technology", "finance", "healthcare", "manufacturing", "retail"], ["sector", "industry", "market"]),
]
CURRENCY_SIGNS = "$€£¥"
CURRENCY_SCALES = ["million", "billion", "trillion"]

# Relation patterns, (type, verbs, particles). Verb i goes with particle i.
RELATION_PATTERNS = [
    ("OWNS", ["owns", "acquired", "purchased", "bought", "acquires", "acquiring"],
     ["subsidiary", "division", "unit", "stake", "shares", "equity"]),
    ("CONTROLS", ["controls", "manages", "operates", "runs", "directs"],
     ["operations", "business", "company", "entity"]),
    ("HAS_SUBSIDIARY", ["subsidiary", "subsidiaries", "wholly-owned"], ["of", "under", "owned by"]),
    ("WORKS_FOR", ["works", "employed", "hired", "joined", "staff", "employee"], ["at", "by", "for", "with"]),
    ("REPORTS_TO", ["reports", "reported", "reporting", "reports directly to"],
     ["to", "under", "under the supervision of"]),
    ("MANAGES", ["manages", "managing", "oversees", "supervises", "leads"],
     ["team", "department", "division", "group"]),
    ("INVESTS_IN", ["invested", "investing", "investment", "funded", "financed"], ["in", "into", "through"]),
    ("HAS_METRIC", ["revenue", "income", "profit", "loss", "earnings", "EBITDA", "EBIT"],
     ["of", "at", "reached", "amounting to", "totaling"]),
    ("HAS_REVENUE", ["revenue", "sales", "turnover", "top line"], ["of", "at", "reached", "amounting to"]),
    ("PARTNERS_WITH", ["partnered", "partnership", "collaborated", "alliance", "joint venture"],
     ["with", "between", "alongside"]),
    ("COMPETES_WITH", ["competes", "competitor", "competition", "rival", "market share"],
     ["with", "against", "in the market"]),
    ("SUPPLIES_TO", ["supplies", "supplier", "vendor", "provides", "sources"], ["to", "for", "on behalf of"]),
    ("OPERATES_IN", ["operates", "operating", "active", "present"], ["in", "within", "across"]),
    ("BELONGS_TO", ["member", "part", "belongs", "affiliated", "associated"], ["of", "to", "with"]),
    ("FOUNDED", ["founded", "established", "created", "incorporated", "started"], ["in", "on", "during"]),
    ("ACQUIRED_ON", ["acquired", "purchased", "bought", "taken over"], ["on", "in", "during"]),
    ("HEADQUARTERED_IN", ["headquartered", "head office", "main office", "corporate office"],
     ["in", "at", "located in"]),
    ("HAS_OFFICE_IN", ["office", "branch", "location", "presence"], ["in", "at", "located in"]),
]

# Which target types a source type may have under a relation.
COMPATIBILITY = {
    "COMPANY": {
        "OWNS": ["COMPANY", "SUBSIDIARY", "DIVISION"],
        "CONTROLS": ["COMPANY", "SUBSIDIARY", "DIVISION"],
        "HAS_SUBSIDIARY": ["SUBSIDIARY"],
        "WORKS_FOR": ["PERSON"],
        "REPORTS_TO": ["PERSON", "POSITION"],
        "INVESTS_IN": ["COMPANY", "PROJECT", "VENTURE"],
        "HAS_METRIC": ["FINANCIAL_METRIC"],
        "HAS_REVENUE": ["CURRENCY", "AMOUNT"],
        "PARTNERS_WITH": ["COMPANY", "ORGANIZATION"],
        "COMPETES_WITH": ["COMPANY"],
        "SUPPLIES_TO": ["COMPANY", "ORGANIZATION"],
        "OPERATES_IN": ["MARKET", "INDUSTRY", "REGION"],
        "BELONGS_TO": ["INDUSTRY", "ASSOCIATION"],
        "HEADQUARTERED_IN": ["LOCATION", "CITY", "COUNTRY"],
        "HAS_OFFICE_IN": ["LOCATION", "CITY", "COUNTRY"],
    },
    "PERSON": {
        "WORKS_FOR": ["COMPANY", "ORGANIZATION"],
        "REPORTS_TO": ["PERSON", "POSITION"],
        "MANAGES": ["TEAM", "DEPARTMENT", "DIVISION"],
        "BOARD_MEMBER": ["COMPANY", "ORGANIZATION"],
        "ADVISOR": ["COMPANY", "ORGANIZATION"],
    },
    "FINANCIAL_METRIC": {
        "HAS_METRIC": ["CURRENCY", "AMOUNT", "PERCENTAGE"],
    },
}

# Sentiment words by polarity and category.
SENTIMENT = {
    "positive": {
        "growth": ["growth", "increase", "rise", "surge", "jump", "spike", "soar", "climb"],
        "profitability": ["profit", "gain", "earnings", "income", "revenue", "margin", "return"],
        "performance": ["outperform", "exceed", "beat", "surpass", "outpace", "outstrip"],
        "strength": ["strong", "robust", "solid", "healthy", "stable", "resilient"],
        "opportunity": ["opportunity", "potential", "prospect", "upside", "promise"],
        "innovation": ["innovative", "breakthrough", "pioneering", "leading", "cutting-edge"],
        "efficiency": ["efficient", "optimized", "streamlined", "productive", "effective"],
        "market_position": ["leader", "dominant", "premium", "preferred", "trusted"],
        "financial_health": ["solvent", "liquid", "well-capitalized", "debt-free", "cash-rich"],
        "dividend": ["dividend", "yield", "payout", "distribution", "return"],
    },
    "negative": {
        "decline": ["decline", "decrease", "fall", "drop", "plunge", "dip", "slump", "tumble"],
        "loss": ["loss", "deficit", "shortfall", "write-down", "write-off", "impairment"],
        "risk": ["risk", "exposure", "vulnerability", "threat", "uncertainty", "volatility"],
        "weakness": ["weak", "fragile", "vulnerable", "exposed", "at risk"],
        "competition": ["competitive", "challenged", "pressured", "squeezed", "eroded"],
        "cost": ["costly", "expensive", "overhead", "burden", "drag"],
        "debt": ["debt", "leverage", "liability", "obligation", "burden"],
        "market_position": ["lagging", "trailing", "struggling", "challenged", "underperforming"],
        "financial_health": ["insolvent", "illiquid", "overleveraged", "distressed", "troubled"],
        "dividend": ["cut", "suspended", "reduced", "eliminated", "missed"],
    },
    "neutral": {
        "trend": ["trend", "pattern", "movement", "direction", "trajectory"],
        "change": ["change", "shift", "adjustment", "modification", "transition"],
        "comparison": ["compared", "relative", "versus", "against"],
        "forecast": ["forecast", "projection", "outlook", "guidance", "expectation"],
        "analysis": ["analysis", "assessment", "evaluation", "review", "examination"],
    },
}

# Words of high and of low certainty.
HIGH_CERTAINTY = ["confirmed", "certain", "definite", "established", "proven"]
LOW_CERTAINTY = ["potential", "possible", "might", "may", "could", "expected"]

# Signs of time and of negation in a context (case is ignored).
TIME_SIGNS = [
    r"\b(?:in|on|during|since|until|before|after)\s+\d{4}\b",
    r"\b(?:annual|quarterly|monthly|yearly)\b",
    r"\b(?:fiscal|financial)\s+year\b",
]
NEGATION_SIGNS = [
    r"\b(?:not|no|never|neither|nor|none|nothing|nowhere)\b",
    r"\b(?:doesn't|don't|didn't|isn't|aren't|wasn't|weren't)\b",
    r"\b(?:failed|declined|rejected|denied)\b",
]

# Context flags by group (case matters). A plain word list stands for \b(words)\b; an entry that
# starts with "re:" is a regular expression as it is.
FLAGS = {
    "temporal": {
        "has_date": r"re:\b\d{4}\b",
        "has_time_period": "annual|quarterly|monthly|yearly",
        "is_historical": "previous|past|former|historic",
        "is_future": "future|upcoming|planned|scheduled",
    },
    "quantitative": {
        "has_amount": r"re:\$\d+(?:,\d+)*(?:\.\d+)?",
        "has_percentage": r"re:\d+(?:\.\d+)?%",
        "has_ratio": r"re:\d+(?:\.\d+)?:\d+(?:\.\d+)?",
    },
    "financial": {
        "has_currency": r"re:\$|€|£|¥",
        "has_amount": r"re:\d+(?:,\d+)*(?:\.\d+)?",
        "has_percentage": r"re:\d+(?:\.\d+)?%",
        "has_ratio": r"re:\d+(?:\.\d+)?:\d+(?:\.\d+)?",
        "is_growth": "growth|increase|up|rise|gain|improvement",
        "is_decline": "decline|decrease|down|fall|drop|reduction",
        "has_timeframe": "annual|quarterly|monthly|yearly|fiscal|financial",
        "has_comparison": "compared|versus|against|relative|previous|prior",
        "has_forecast": "forecast|projection|outlook|guidance|expectation",
        "has_benchmark": "benchmark|target|goal|objective|milestone",
        "has_risk": "risk|exposure|vulnerability|uncertainty|volatility",
        "has_hedge": "hedge|hedging|protection|mitigation|safeguard",
    },
    "transaction": {
        "has_amount": r"re:\$\d+(?:,\d+)*(?:\.\d+)?",
        "has_date": r"re:\b\d{4}\b",
        "has_valuation": "valuation|value|worth|price|cost",
        "has_consideration": "consideration|payment|compensation|exchange",
        "has_structure": "structure|form|type|nature|arrangement",
        "has_terms": "terms|conditions|provisions|agreement|contract",
        "has_approval": "approved|approval|authorized|authorization|consent",
        "has_closing": "closing|completion|finalization|execution|consummation",
        "has_announcement": "announced|announcement|disclosure|release|statement",
        "has_regulatory": "regulatory|approval|clearance|consent|authorization",
        "has_synergy": "synergy|benefit|advantage|opportunity|potential",
        "has_risk": "risk|exposure|uncertainty|challenge|concern",
    },
    "location": {
        "has_country": "country|nation|state|province",
        "has_city": "city|town|municipality|metro",
        "has_region": "region|area|zone|territory",
        "has_address": "address|street|avenue|road|boulevard",
        "has_coordinates": "latitude|longitude|coordinates|GPS",
        "is_headquarters": "headquarters|HQ|head office|main office",
        "is_branch": "branch|office|location|outlet",
        "is_facility": "facility|plant|factory|warehouse",
    },
    "ip": {
        "has_patent_number": r"re:\b(?:patent|pat\.|pat\. no\.)\s*#?\s*[A-Z0-9-]+\b",
        "has_trademark": "trademark|™|®|registered mark",
        "has_license_number": r"re:\b(?:license|lic\.|lic\. no\.)\s*#?\s*[A-Z0-9-]+\b",
        "has_expiration": "expires|expiration|valid until|valid through",
        "has_application_date": "filed|applied|application date",
        "has_grant_date": "granted|issued|grant date",
        "is_pending": "pending|under review|in process",
        "is_expired": "expired|lapsed|terminated",
    },
    "regulatory": {
        "has_regulator": "regulator|regulatory|authority|agency",
        "has_certification": "certified|certification|accredited|accreditation",
        "has_compliance": "complies|compliance|conforms|conformity",
        "has_standard": "standard|requirement|guideline|specification",
        "has_inspection": "inspected|inspection|audited|audit",
        "has_violation": "violation|breach|non-compliance|infraction",
        "has_penalty": "penalty|fine|sanction|punishment",
        "has_approval": "approved|approval|authorized|authorization",
    },
    "valuation": {
        "has_enterprise_value": "enterprise value|EV",
        "has_equity_value": "equity value|market cap|market capitalization",
        "has_valuation_multiple": "valuation multiple|multiple|x",
        "has_discount_rate": "discount rate|required return|hurdle rate",
        "has_growth_rate": "growth rate|growth projection|growth forecast",
        "has_terminal_value": "terminal value|perpetuity value",
        "has_synergy_value": "synergy value|synergy benefits|cost synergies",
        "has_premium": "premium|acquisition premium|takeover premium",
        "has_control_premium": "control premium|minority discount",
        "has_liquidity_discount": "liquidity discount|marketability discount",
    },
    "synergy": {
        "has_cost_synergies": "cost synergies|cost savings|operating synergies",
        "has_revenue_synergies": "revenue synergies|revenue growth|top-line synergies",
        "has_technology_synergies": "technology synergies|technical synergies|R&D synergies",
        "has_market_synergies": "market synergies|market access|distribution synergies",
        "has_scale_synergies": "scale synergies|economies of scale|operating leverage",
        "has_scope_synergies": "scope synergies|scope economies|diversification benefits",
        "has_financial_synergies": "financial synergies|tax synergies|financing synergies",
        "has_management_synergies": "management synergies|leadership synergies|talent synergies",
        "has_cultural_synergies": "cultural synergies|cultural fit|organizational synergies",
        "has_strategic_synergies": "strategic synergies|strategic benefits|strategic advantages",
    },
    "geographic": {
        "has_continent": "continent|region|area",
        "has_country": "country|nation|state|province",
        "has_city": "city|town|municipality|metro",
        "has_address": "address|street|avenue|road|boulevard",
        "has_coordinates": "latitude|longitude|coordinates|GPS",
        "has_timezone": "timezone|time zone|UTC|GMT",
        "has_climate": "climate|weather|temperature|precipitation",
        "has_population": "population|inhabitants|residents|citizens",
        "has_economy": "economy|GDP|GNP|economic indicators",
        "has_infrastructure": "infrastructure|transportation|utilities|facilities",
    },
    "ip_valuation": {
        "has_patent_value": "patent value|patent worth|patent valuation",
        "has_trademark_value": "trademark value|brand value|brand worth",
        "has_license_value": "license value|royalty value|license worth",
        "has_royalty_rate": "royalty rate|royalty percentage|license fee",
        "has_remaining_life": "remaining life|patent term|license term",
        "has_technology_readiness": "technology readiness|TRL|development stage",
        "has_market_potential": "market potential|market size|addressable market",
        "has_competitive_advantage": "competitive advantage|market position|competitive position",
        "has_legal_protection": "legal protection|enforcement|infringement",
        "has_development_cost": "development cost|R&D cost|research cost",
    },
    "compliance": {
        "has_compliance_program": "compliance program|compliance framework|compliance system",
        "has_risk_assessment": "risk assessment|risk analysis|risk evaluation",
        "has_controls": "controls|internal controls|control framework",
        "has_monitoring": "monitoring|surveillance|oversight",
        "has_reporting": "reporting|disclosure|filing",
        "has_training": "training|education|awareness",
        "has_audit": "audit|review|examination",
        "has_remediation": "remediation|corrective action|improvement",
        "has_whistleblower": "whistleblower|reporting line|hotline",
        "has_documentation": "documentation|records|evidence",
    },
}

# Flag groups and phrase kinds that are looked at only for certain relation types.
EXTRA_GROUPS = [
    (["HAS_METRIC", "HAS_REVENUE", "HAS_PROFIT", "HAS_ASSET", "HAS_LIABILITY"], ["financial"]),
    (["ACQUIRES", "MERGES_WITH", "JOINT_VENTURE", "STRATEGIC_ALLIANCE"], ["transaction", "valuation", "synergy"]),
    (["OPERATES_IN", "HEADQUARTERED_IN", "HAS_OFFICE_IN"], ["location", "geographic"]),
    (["HAS_PATENT", "HAS_TRADEMARK", "HAS_LICENSE"], ["ip", "ip_valuation"]),
    (["REGULATED_BY", "CERTIFIED_BY", "COMPLIES_WITH"], ["regulatory", "compliance"]),
]
PHRASE_RELATIONS = EXTRA_GROUPS[0][0]

# Pieces of the phrase patterns (case is ignored).
PHRASE = r"(\w+(?:\s+\w+)*)"
MONEY = r"(\$?\d+(?:,\d+)*(?:\.\d+)?(?:\s*(?:million|billion|trillion))?)"
AMOUNT = r"(\$?\d+(?:,\d+)*(?:\.\d+)?)"
PERCENT = r"(\d+(?:\.\d+)?%)"
RATIO = r"(\d+(?:\.\d+)?:\d+(?:\.\d+)?)"
NUMBER = r"(\d+(?:\.\d+)?)"
REACH = r"\s+(?:of|at|reached|amounting to|totaling)\s+"
MOVE = r"\s+(?:increased|decreased|grew|declined|rose|fell)\s+(?:by|to)\s+"
PER = r"\s+(?:to|per)\s+"
MULTIPLE = r"\s+(?:ratio|multiple)"
COMPARED = r"\s+(?:compared to|versus|vs\.?)\s+"
YEARLY = r"\s+(?:annually|per year|yearly|yoy|y/y)"

# Metric phrases; groups are metric, value and, for a range, a second value.
METRIC_PHRASES = [
    ("basic", PHRASE + REACH + MONEY),
    ("percentage", PHRASE + REACH + PERCENT),
    ("ratio", PHRASE + REACH + RATIO),
    ("year_over_year", PHRASE + MOVE + PERCENT + r"\s+(?:year-over-year|yoy|y/y)"),
    ("quarter_over_quarter", PHRASE + MOVE + PERCENT + r"\s+(?:quarter-over-quarter|qoq|q/q)"),
    ("sequential", PHRASE + MOVE + PERCENT + r"\s+(?:sequentially|seq)"),
    ("comparison", PHRASE + COMPARED + MONEY),
    ("range", PHRASE + r"\s+(?:between|from)\s+" + AMOUNT + r"\s+(?:and|to)\s+" + AMOUNT),
    ("forecast", PHRASE + r"\s+(?:is expected|is projected|is forecasted|is estimated)"
                          r"\s+(?:to be|to reach|to amount to)\s+" + MONEY),
    ("guidance", PHRASE + r"\s+(?:guidance|outlook|forecast)\s+(?:of|at|for)\s+" + MONEY),
]

# Ratio phrases; groups are numerator, denominator, value and, for a trend, a second value.
RATIO_PHRASES = [
    ("basic", PHRASE + PER + PHRASE + MULTIPLE + REACH + NUMBER),
    ("industry", PHRASE + PER + PHRASE + MULTIPLE + COMPARED + r"(?:industry average|peer group|competitors)"
                 + REACH + NUMBER),
    ("historical", PHRASE + PER + PHRASE + MULTIPLE + COMPARED + r"(?:previous year|last year|prior year)"
                   + REACH + NUMBER),
    ("trend", PHRASE + PER + PHRASE + MULTIPLE + r"\s+(?:has|have)\s+(?:increased|decreased|improved|deteriorated)"
              r"\s+(?:from|to)\s+" + NUMBER + r"\s+(?:to|from)\s+" + NUMBER),
]

# Trend phrases; groups are metric and value.
TREND_PHRASES = [
    ("growth", PHRASE + r"\s+(?:has|have)\s+(?:grown|increased|risen|climbed)\s+(?:by|at)\s+" + PERCENT + YEARLY),
    ("decline", PHRASE + r"\s+(?:has|have)\s+(?:declined|decreased|fallen|dropped)\s+(?:by|at)\s+" + PERCENT + YEARLY),
    ("compound", PHRASE + r"\s+(?:has|have)\s+(?:grown|increased|risen|climbed)\s+(?:at a|at an)"
                 r"\s+(?:compound annual growth rate|CAGR)" + REACH + PERCENT),
    ("seasonal", PHRASE + r"\s+(?:shows|exhibits|displays)\s+(?:seasonal|cyclical)"
                 r"\s+(?:pattern|trend|variation)\s+(?:with|of)\s+" + PERCENT
                 + r"\s+(?:variation|fluctuation|change)"),
]


def flag_pattern(entry: str) -> str:
    """The regular expression of an entry of the flag table."""
    return entry[3:] if entry.startswith("re:") else rf"\b(?:{entry})\b"


def flag_rows() -> list[tuple[str, str, str]]:
    """(group, flag, regular expression)"""
    return [(group, name, flag_pattern(entry)) for group, flags in FLAGS.items() for name, entry in flags.items()]


def pattern_rows() -> list[tuple[str, int, str, str]]:
    """(relation type, declared order, verb, particle); verb and particle share a position in their lists."""
    return [
        (rel, ord_, verb, prep)
        for ord_, (rel, verbs, preps) in enumerate(RELATION_PATTERNS)
        for verb, prep in zip(verbs, preps)
    ]


def compatibility_rows() -> list[tuple[str, str, str]]:
    return [(s, r, t) for s, rels in COMPATIBILITY.items() for r, targets in rels.items() for t in targets]


def sentiment_rows() -> list[tuple[str, str, str]]:
    """(polarity, category, term)"""
    return [(p, c, t) for p, cats in SENTIMENT.items() for c, terms in cats.items() for t in terms]
