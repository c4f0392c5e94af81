"""The 22 validation rules, as plain data, and their flattening to one row per check."""

from __future__ import annotations

INF = float("inf")
POSITIVE = (0.0, INF)
ANY = (-INF, INF)
PERCENT = (0.0, 100.0)
SHARE = (0.0, 1.0)

# Rules on entities of a type.
ENTITY_RULES = {
    "company_required_fields": {
        "type": "Company",
        "required": ["name", "industry", "founding_date"],
        "patterns": {"ticker": r"^[A-Z]{1,5}$", "website": r"^https?://[^\s/$.?#].[^\s]*$"},
        "unique": ["ticker", "name"],
        "metrics": ["revenue", "market_cap", "employees"],
        "metric_ranges": {"revenue": POSITIVE, "market_cap": POSITIVE, "employees": (1.0, INF)},
    },
    "person_required_fields": {
        "type": "Person",
        "required": ["name", "role"],
        "patterns": {"email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$", "phone": r"^\+?[1-9]\d{1,14}$"},
        "period": ("birth_date", "death_date"),
    },
    "financial_instrument_required_fields": {
        "type": "FinancialInstrument",
        "required": ["name", "type", "issuer"],
        "patterns": {"isin": r"^[A-Z]{2}[A-Z0-9]{9}[0-9]$", "cusip": r"^[0-9A-Z]{9}$"},
        "metrics": ["face_value", "maturity_date"],
        "metric_ranges": {"face_value": POSITIVE, "coupon_rate": PERCENT},
        "documents": ["prospectus", "offering_memorandum"],
    },
    "transaction_required_fields": {
        "type": "Transaction",
        "required": ["amount", "date", "type"],
        "metrics": ["amount", "currency", "exchange_rate"],
        "metric_ranges": {"amount": POSITIVE, "exchange_rate": POSITIVE},
        "period": ("transaction_date", "settlement_date"),
    },
}

# Rules on relationships of a type.
RELATIONSHIP_RULES = {
    "company_person_relationship": {
        "type": "EMPLOYMENT", "source_type": "Company", "target_type": "Person",
        "required": ["start_date", "role"],
        "dates": ["start_date"],
        "cardinality": {"max_roles_per_person": 1, "max_companies_per_role": 1},
    },
    "company_financial_instrument": {
        "type": "ISSUES", "source_type": "Company", "target_type": "FinancialInstrument",
        "required": ["issue_date", "issue_price"],
        "metrics": ["issue_price", "issue_size"],
        "metric_ranges": {"issue_price": POSITIVE, "issue_size": POSITIVE},
        "documents": ["offering_document", "regulatory_filing"],
    },
    "transaction_relationship": {
        "type": "TRANSACTION", "source_type": "Person", "target_type": "FinancialInstrument",
        "required": ["transaction_date", "amount", "currency"],
        "metrics": ["amount", "currency", "exchange_rate"],
        "metric_ranges": {"amount": POSITIVE, "exchange_rate": POSITIVE},
        "dates": ["transaction_date", "settlement_date"],
    },
}

# Rules of the 15 business domains, on entities of a type.
DOMAIN_RULES = {
    "banking_account_validation": {
        "type": "Account", "domain": "banking",
        "required": ["account_number", "account_type", "currency", "balance"],
        "patterns": {"account_number": r"^[A-Z0-9]{8,20}$", "iban": r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{1,30}$",
                     "swift_code": r"^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$"},
        "metrics": ["balance", "interest_rate", "overdraft_limit"],
        "metric_ranges": {"balance": ANY, "interest_rate": PERCENT, "overdraft_limit": POSITIVE},
        "compliance": ["KYC", "AML", "Transaction Monitoring", "Risk Assessment"],
        "risks": ["credit_risk", "operational_risk", "market_risk", "liquidity_risk"],
    },
    "investment_portfolio_validation": {
        "type": "Portfolio", "domain": "investment",
        "required": ["portfolio_id", "investor_id", "risk_profile", "investment_strategy"],
        "metrics": ["total_value", "risk_score", "diversification_ratio"],
        "metric_ranges": {"total_value": POSITIVE, "risk_score": (1.0, 10.0), "diversification_ratio": SHARE},
        "compliance": ["Suitability Assessment", "Best Execution", "Transaction Reporting", "Client Categorization"],
        "risks": ["market_risk", "credit_risk", "liquidity_risk", "concentration_risk"],
    },
    "insurance_policy_validation": {
        "type": "Policy", "domain": "insurance",
        "required": ["policy_number", "coverage_type", "premium", "coverage_amount"],
        "patterns": {"policy_number": r"^[A-Z0-9]{10,15}$",
                     "coverage_type": r"^(LIFE|HEALTH|PROPERTY|LIABILITY|AUTO)$"},
        "metrics": ["premium", "coverage_amount", "deductible"],
        "metric_ranges": {"premium": POSITIVE, "coverage_amount": POSITIVE, "deductible": POSITIVE},
        "compliance": ["Policy Documentation", "Risk Assessment", "Claims Processing", "Reserve Requirements"],
        "risks": ["underwriting_risk", "reserve_risk", "catastrophe_risk", "operational_risk"],
    },
    "real_estate_property_validation": {
        "type": "Property", "domain": "real_estate",
        "required": ["property_id", "address", "property_type", "valuation"],
        "patterns": {"property_id": r"^[A-Z0-9]{8,12}$",
                     "property_type": r"^(RESIDENTIAL|COMMERCIAL|INDUSTRIAL|LAND)$"},
        "metrics": ["valuation", "rental_income", "operating_expenses"],
        "metric_ranges": {"valuation": POSITIVE, "rental_income": POSITIVE, "operating_expenses": POSITIVE},
        "compliance": ["Property Documentation", "Valuation Standards", "Environmental Assessment",
                       "Zoning Compliance"],
        "risks": ["market_risk", "location_risk", "environmental_risk", "legal_risk"],
    },
    "crypto_asset_validation": {
        "type": "CryptoAsset", "domain": "crypto",
        "required": ["asset_id", "blockchain", "token_standard", "total_supply"],
        "patterns": {"asset_id": r"^[A-Z0-9]{3,10}$", "token_standard": r"^(ERC20|ERC721|ERC1155|BEP20)$"},
        "metrics": ["market_cap", "circulating_supply", "trading_volume"],
        "metric_ranges": {"market_cap": POSITIVE, "circulating_supply": POSITIVE, "trading_volume": POSITIVE},
        "compliance": ["KYC/AML", "Transaction Monitoring", "Smart Contract Audit", "Security Assessment"],
        "risks": ["market_risk", "technical_risk", "regulatory_risk", "security_risk"],
    },
    "fintech_service_validation": {
        "type": "FintechService", "domain": "fintech",
        "required": ["service_id", "service_type", "api_version", "security_level"],
        "patterns": {"service_id": r"^[A-Z0-9]{6,12}$", "api_version": r"^v[0-9]+\.[0-9]+\.[0-9]+$"},
        "metrics": ["uptime", "response_time", "error_rate"],
        "metric_ranges": {"uptime": PERCENT, "response_time": (0.0, 1000.0), "error_rate": SHARE},
        "compliance": ["API Security", "Data Protection", "Service Level Agreement", "Incident Response"],
        "risks": ["operational_risk", "security_risk", "compliance_risk", "reputation_risk"],
    },
    "regulatory_report_validation": {
        "type": "RegulatoryReport", "domain": "regulatory",
        "required": ["report_id", "report_type", "reporting_period", "submission_date"],
        "patterns": {"report_id": r"^[A-Z0-9]{10,15}$", "report_type": r"^(FINANCIAL|COMPLIANCE|RISK|AUDIT)$"},
        "metrics": ["completeness_score", "accuracy_score", "timeliness_score"],
        "metric_ranges": {"completeness_score": PERCENT, "accuracy_score": PERCENT, "timeliness_score": PERCENT},
        "compliance": ["Data Accuracy", "Timely Submission", "Documentation", "Audit Trail"],
        "risks": ["compliance_risk", "reporting_risk", "audit_risk", "reputation_risk"],
    },
    "compliance_check_validation": {
        "type": "ComplianceCheck", "domain": "compliance",
        "required": ["check_id", "check_type", "check_date", "status"],
        "patterns": {"check_id": r"^[A-Z0-9]{8,12}$", "check_type": r"^(KYC|AML|SANCTIONS|PEP|ADVERSE_MEDIA)$"},
        "metrics": ["risk_score", "confidence_score", "completion_rate"],
        "metric_ranges": {"risk_score": PERCENT, "confidence_score": PERCENT, "completion_rate": PERCENT},
        "compliance": ["Risk Assessment", "Due Diligence", "Documentation", "Monitoring"],
        "risks": ["compliance_risk", "operational_risk", "reputation_risk", "legal_risk"],
    },
    "wealth_portfolio_validation": {
        "type": "Portfolio", "domain": "wealth_management",
        "required": ["portfolio_id", "client_id", "risk_profile", "investment_strategy", "asset_allocation"],
        "metrics": ["total_value", "risk_score", "diversification_ratio", "sharpe_ratio", "alpha"],
        "metric_ranges": {"total_value": POSITIVE, "risk_score": (1.0, 10.0), "diversification_ratio": SHARE,
                          "sharpe_ratio": ANY, "alpha": ANY},
        "compliance": ["Suitability Assessment", "Best Execution", "Transaction Reporting", "Client Categorization",
                       "Portfolio Rebalancing", "Performance Attribution"],
        "risks": ["market_risk", "credit_risk", "liquidity_risk", "concentration_risk", "currency_risk",
                  "interest_rate_risk"],
    },
    "hedge_fund_validation": {
        "type": "Fund", "domain": "hedge_fund",
        "required": ["fund_id", "strategy", "aum", "leverage_ratio", "performance_fee", "management_fee"],
        "metrics": ["aum", "leverage_ratio", "performance_fee", "management_fee", "sharpe_ratio", "sortino_ratio"],
        "metric_ranges": {"aum": POSITIVE, "leverage_ratio": POSITIVE, "performance_fee": (0.0, 50.0),
                          "management_fee": (0.0, 5.0), "sharpe_ratio": ANY, "sortino_ratio": ANY},
        "compliance": ["Risk Management", "Leverage Limits", "Reporting Requirements", "Investor Protection",
                       "Transparency"],
        "risks": ["market_risk", "credit_risk", "liquidity_risk", "leverage_risk", "counterparty_risk",
                  "model_risk"],
    },
    "private_equity_validation": {
        "type": "Fund", "domain": "private_equity",
        "required": ["fund_id", "vintage_year", "target_size", "committed_capital", "called_capital",
                     "distributed_capital"],
        "metrics": ["irr", "moic", "rvpi", "dvpi", "total_value_to_paid_in"],
        "metric_ranges": {"irr": (-100.0, INF), "moic": POSITIVE, "rvpi": POSITIVE, "dvpi": POSITIVE,
                          "total_value_to_paid_in": POSITIVE},
        "compliance": ["Investment Strategy", "Capital Calls", "Distributions", "Valuation", "Reporting"],
        "risks": ["investment_risk", "valuation_risk", "liquidity_risk", "concentration_risk", "exit_risk"],
    },
    "venture_capital_validation": {
        "type": "Fund", "domain": "venture_capital",
        "required": ["fund_id", "vintage_year", "target_size", "committed_capital", "called_capital",
                     "portfolio_companies"],
        "metrics": ["irr", "moic", "rvpi", "dvpi", "total_value_to_paid_in", "portfolio_diversity_score"],
        "metric_ranges": {"irr": (-100.0, INF), "moic": POSITIVE, "rvpi": POSITIVE, "dvpi": POSITIVE,
                          "total_value_to_paid_in": POSITIVE, "portfolio_diversity_score": SHARE},
        "compliance": ["Investment Strategy", "Capital Calls", "Distributions", "Valuation", "Reporting",
                       "Portfolio Management"],
        "risks": ["investment_risk", "valuation_risk", "liquidity_risk", "concentration_risk", "exit_risk",
                  "technology_risk"],
    },
    "asset_management_validation": {
        "type": "Company", "domain": "asset_management",
        "required": ["company_id", "aum", "number_of_funds", "investment_strategies", "client_types"],
        "metrics": ["aum", "revenue", "profit_margin", "client_retention_rate", "fund_performance"],
        "metric_ranges": {"aum": POSITIVE, "revenue": POSITIVE, "profit_margin": PERCENT,
                          "client_retention_rate": PERCENT, "fund_performance": ANY},
        "compliance": ["Risk Management", "Client Reporting", "Performance Attribution", "Compliance Monitoring",
                       "Client Communication"],
        "risks": ["market_risk", "operational_risk", "compliance_risk", "reputation_risk", "client_risk"],
    },
    "market_making_validation": {
        "type": "Company", "domain": "market_making",
        "required": ["company_id", "trading_venues", "instruments", "inventory_limits", "risk_limits"],
        "metrics": ["inventory_value", "spread", "volume", "profit_loss", "risk_metrics"],
        "metric_ranges": {"inventory_value": ANY, "spread": POSITIVE, "volume": POSITIVE, "profit_loss": ANY,
                          "risk_metrics": ANY},
        "compliance": ["Best Execution", "Market Making Obligations", "Risk Management", "Reporting", "Compliance"],
        "risks": ["market_risk", "inventory_risk", "liquidity_risk", "operational_risk", "regulatory_risk"],
    },
    "quantitative_trading_validation": {
        "type": "System", "domain": "quantitative_trading",
        "required": ["system_id", "strategy_type", "trading_parameters", "risk_parameters", "performance_metrics"],
        "metrics": ["sharpe_ratio", "sortino_ratio", "max_drawdown", "win_rate", "profit_factor"],
        "metric_ranges": {"sharpe_ratio": ANY, "sortino_ratio": ANY, "max_drawdown": (-100.0, 0.0),
                          "win_rate": PERCENT, "profit_factor": POSITIVE},
        "compliance": ["Algorithm Testing", "Risk Management", "Monitoring", "Reporting", "Compliance"],
        "risks": ["model_risk", "execution_risk", "market_risk", "operational_risk", "regulatory_risk"],
    },
}

# Fixed value: confidence below which an entity is reported.
CONFIDENCE_THRESHOLD = 0.7

CHECK_COLUMNS = "rule string, kind string, type string, domain string, check string, field string, " \
                "pattern string, min double, max double, enabled boolean"


def _checks(rule: str, kind: str, spec: dict, enabled: bool = True) -> list[tuple]:
    head = (rule, kind, spec["type"], spec.get("domain"))

    def row(check, field, pattern=None, lo=None, hi=None):
        return (*head, check, field, pattern, lo, hi, enabled)

    rows = [row("required", f) for f in spec.get("required", [])]
    rows += [row("pattern", f, p) for f, p in spec.get("patterns", {}).items()]
    rows += [row("range", f, None, *r) for f, r in spec.get("ranges", {}).items()]
    rows += [row("date", f) for f in spec.get("dates", [])]
    rows += [row("metric", f) for f in spec.get("metrics", [])]
    rows += [row("metric_range", f, None, *r) for f, r in spec.get("metric_ranges", {}).items()]
    rows += [row("document", f) for f in spec.get("documents", [])]
    rows += [row("compliance", f) for f in spec.get("compliance", [])]
    rows += [row("risk", f) for f in spec.get("risks", [])]
    return rows


def domain_fields(spec: dict) -> list[str]:
    """All fields that a rule looks at, in alphabetical order."""
    return sorted({*spec.get("required", []), *spec.get("patterns", {}), *spec.get("metrics", []), *spec.get("metric_ranges", {})})


def check_rows() -> list[tuple]:
    """One row per check of every rule; a domain rule also applies to entities when validated without a domain."""
    return [
        row
        for kind, rules in (("entity", ENTITY_RULES), ("relationship", RELATIONSHIP_RULES), ("domain", DOMAIN_RULES))
        for rule, spec in rules.items()
        for row in _checks(rule, kind, spec)
    ]


def rule_rows() -> list[tuple]:
    """(rule, kind, type, domain, source type, target type, enabled)"""
    return [
        (rule, kind, s["type"], s.get("domain"), s.get("source_type"), s.get("target_type"), True)
        for kind, rules in (("entity", ENTITY_RULES), ("relationship", RELATIONSHIP_RULES), ("domain", DOMAIN_RULES))
        for rule, s in rules.items()
    ]
