"""Document types: keywords, patterns, fields."""

# Keywords, regular expressions and (name, key, required) fields of each recognised type.
DOCUMENT_TYPES = {
    "invoice": {
        "keywords": ["invoice", "bill", "statement", "amount due", "payment terms", "invoice number",
                     "invoice date", "due date", "total amount", "subtotal", "tax", "balance due", "please pay"],
        "patterns": [r"invoice\s+#?\d+", r"bill\s+to:", r"amount\s+due:?\s*\$", r"payment\s+terms:",
                     r"due\s+date:"],
        "fields": [("Invoice Number", "invoice_number", True), ("Invoice Date", "invoice_date", True),
                   ("Due Date", "due_date", False), ("Vendor/Supplier", "vendor", True),
                   ("Customer/Bill To", "customer", True), ("Subtotal", "subtotal", False),
                   ("Tax Amount", "tax_amount", False), ("Total Amount", "total_amount", True),
                   ("Payment Terms", "payment_terms", False), ("Description", "description", False)],
    },
    "receipt": {
        "keywords": ["receipt", "thank you", "payment received", "transaction", "merchant", "store", "cashier",
                     "register", "sale", "purchase", "item", "quantity", "price"],
        "patterns": [r"receipt\s+#?\d+", r"thank\s+you\s+for\s+your\s+purchase", r"merchant:\s+",
                     r"transaction\s+id:", r"payment\s+received"],
        "fields": [("Receipt Number", "receipt_number", True), ("Date", "date", True),
                   ("Merchant/Store", "merchant", True), ("Transaction ID", "transaction_id", False),
                   ("Items", "items", False), ("Subtotal", "subtotal", False), ("Tax", "tax", False),
                   ("Total Amount", "total_amount", True), ("Payment Method", "payment_method", False)],
    },
    "bank_statement": {
        "keywords": ["bank statement", "account statement", "account number", "balance", "deposits",
                     "withdrawals", "transactions", "opening balance", "closing balance", "bank name"],
        "patterns": [r"bank\s+statement", r"account\s+statement", r"account\s+#?\d+",
                     r"opening\s+balance:?\s*\$", r"closing\s+balance:?\s*\$", r"statement\s+period:"],
        "fields": [("Bank Name", "bank_name", True), ("Account Number", "account_number", True),
                   ("Statement Period", "statement_period", True), ("Opening Balance", "opening_balance", True),
                   ("Closing Balance", "closing_balance", True), ("Total Deposits", "total_deposits", False),
                   ("Total Withdrawals", "total_withdrawals", False), ("Transactions", "transactions", False)],
    },
    "financial_report": {
        "keywords": ["financial report", "annual report", "quarterly report", "income statement",
                     "balance sheet", "cash flow", "revenue", "expenses", "profit", "loss", "assets",
                     "liabilities", "equity", "earnings", "ebitda"],
        "patterns": [r"financial\s+report", r"annual\s+report", r"quarterly\s+report", r"income\s+statement",
                     r"balance\s+sheet", r"cash\s+flow\s+statement", r"revenue:?\s*\$", r"total\s+assets:?\s*\$"],
        "fields": [("Report Type", "report_type", True), ("Period", "period", True),
                   ("Company Name", "company_name", True), ("Revenue", "revenue", False),
                   ("Expenses", "expenses", False), ("Net Income", "net_income", False),
                   ("Total Assets", "total_assets", False), ("Total Liabilities", "total_liabilities", False),
                   ("Shareholders Equity", "shareholders_equity", False)],
    },
    "contract": {
        "keywords": ["contract", "agreement", "terms and conditions", "parties", "effective date",
                     "expiration date", "signature", "witness", "notary", "legal"],
        "patterns": [r"contract\s+between", r"agreement\s+dated", r"effective\s+date:", r"expiration\s+date:",
                     r"party\s+a:", r"party\s+b:", r"terms\s+and\s+conditions"],
        "fields": [("Contract Type", "contract_type", True), ("Parties", "parties", True),
                   ("Effective Date", "effective_date", True), ("Expiration Date", "expiration_date", False),
                   ("Contract Value", "contract_value", False), ("Terms", "terms", False),
                   ("Signatures", "signatures", False)],
    },
    "tax_document": {
        "keywords": ["tax return", "w-2", "1099", "irs", "tax form", "adjusted gross income", "taxable income",
                     "refund", "tax due", "social security", "federal tax"],
        "patterns": [r"form\s+w-?2", r"form\s+1099", r"tax\s+return", r"adjusted\s+gross\s+income",
                     r"taxable\s+income", r"federal\s+tax\s+withheld"],
        "fields": [("Tax Form Type", "tax_form_type", True), ("Tax Year", "tax_year", True),
                   ("Taxpayer Name", "taxpayer_name", True), ("Social Security Number", "ssn", False),
                   ("Adjusted Gross Income", "agi", False), ("Taxable Income", "taxable_income", False),
                   ("Federal Tax Withheld", "federal_tax_withheld", False), ("Refund Amount", "refund_amount", False),
                   ("Tax Due", "tax_due", False)],
    },
}

# Fields of a document whose type is not known.
GENERIC_FIELDS = [("Document Type", "document_type", False), ("Date", "date", False), ("Amount", "amount", False),
                  ("Parties", "parties", False), ("Description", "description", False),
                  ("Reference Number", "reference_number", False)]

# Fields that every suggested schema gets.
COMMON_FIELDS = [("Document Type", "document_type", True), ("Date", "date", False), ("Title", "title", False),
                 ("Author/Company", "author", False)]

# The field keys a mention label fills, first choice first, by document type.
LABEL_FIELDS = {
    "invoice": {
        "PERSON": ["customer", "vendor"],
        "COMPANY": ["vendor", "customer"],
        "CURRENCY": ["total_amount", "subtotal", "tax_amount"],
        "DATE": ["invoice_date", "due_date"],
        "FINANCIAL_METRIC": ["total_amount", "subtotal"],
    },
    "receipt": {
        "PERSON": ["merchant"],
        "COMPANY": ["merchant"],
        "CURRENCY": ["total_amount", "subtotal", "tax"],
        "DATE": ["date"],
        "FINANCIAL_METRIC": ["total_amount"],
    },
    "bank_statement": {
        "COMPANY": ["bank_name"],
        "CURRENCY": ["opening_balance", "closing_balance", "total_deposits", "total_withdrawals"],
        "DATE": ["statement_period"],
        "FINANCIAL_METRIC": ["opening_balance", "closing_balance"],
    },
    "financial_report": {
        "COMPANY": ["company_name"],
        "CURRENCY": ["revenue", "expenses", "net_income", "total_assets", "total_liabilities"],
        "DATE": ["period"],
        "FINANCIAL_METRIC": ["revenue", "expenses", "net_income", "total_assets"],
    },
}

# The types a model reply may name.
REPLY_TYPES = ["invoice", "receipt", "bank_statement", "financial_report", "contract", "tax_document",
               "insurance_policy", "loan_agreement", "business_plan", "marketing_material", "research_report",
               "white_paper", "presentation", "memo", "letter", "custom", "unknown"]

# Score above which a type is taken, and the least confidence of a generated type.
CLASS_THRESHOLD = 0.1
GENERATED_CONFIDENCE = 0.7

# Files that are let in, and the largest size.
ACCEPTED_SUFFIXES = ["pdf"]
MAX_FILE_BYTES = 50 * 1024 * 1024


def field_rows() -> list[tuple[str, int, str, str, bool]]:
    """(document type, ordinal, name, key, required)"""
    types = [(name, spec["fields"]) for name, spec in DOCUMENT_TYPES.items()] + [("unknown", GENERIC_FIELDS)]
    return [(t, i, *field) for t, fields in types for i, field in enumerate(fields)]
