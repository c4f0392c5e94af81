"""Quality metric weights and advice."""

# Weight of each quality metric in the overall score.
METRIC_WEIGHTS = {
    "completeness": 0.2,
    "consistency": 0.15,
    "accuracy": 0.15,
    "timeliness": 0.1,
    "validity": 0.1,
    "reliability": 0.1,
    "integrity": 0.05,
    "conformity": 0.05,
    "uniqueness": 0.05,
    "business_rules": 0.05,
}

# Advice per metric, (metric, detail it needs, action, value below which it is urgent).
ADVICE = [
    ("completeness", "affected_entities", "add_missing_fields", 0.5),
    ("consistency", "inconsistent_fields", "standardize_values", 0.7),
    ("accuracy", "validation_errors", "correct_errors", 0.8),
    ("timeliness", "stale_data", "update_data", 0.6),
    ("validity", "invalid_values", "validate_data", 0.9),
]

# Weight of an error and of a warning in the confidence of a validation report.
ERROR_WEIGHT, WARNING_WEIGHT = 0.7, 0.3

# Weight of a severity in the risk score.
SEVERITY_WEIGHTS = {"high": 3, "medium": 2, "low": 1}
RISK_RELATIONS = ["HAS_RISK", "EXPOSED_TO", "DEPENDS_ON", "COMPETES_WITH"]
