"""Rule data of the quality model.

Everything here is a fixed value: word lists, patterns, thresholds, weights
and texts that decide the scores. Operators turn them into column
expressions or into small broadcastable DataFrames; nothing below executes.
Patterns are written for Unicode-aware matching (see functions.text.rx).
"""

# ---------------------------------------------------------------- fixed values: files
SUPPORTED_EXTENSIONS = [
    ".pdf", ".docx", ".png", ".jpg", ".jpeg",
    ".json", ".txt", ".csv", ".xml", ".html", ".htm", ".eml",
]
MAX_FILE_BYTES = 5 * 1024 * 1024
IMAGE_EXTENSIONS = [".png", ".jpg", ".jpeg", ".tiff", ".bmp"]
EXTENSION_FAMILY = {
    ".json": "json",
    ".csv": "tabular",
    ".xml": "markup",
    ".html": "markup",
    ".htm": "markup",
    ".eml": "email",
}

# ---------------------------------------------------------------- fixed values: types
FAMILY_ALIASES = {
    "contract": ["contract"],
    "invoice": ["invoice"],
    "json": ["json", "json_document", "json_data"],
    "social_media": ["social_media", "social media", "tweet", "post", "social media post"],
    "tabular": ["tabular", "csv", "table", "dataset", "spreadsheet"],
    "markup": ["markup", "xml", "html", "htm", "webpage"],
    "email": ["email", "eml", "mail", "message"],
}
DEFAULT_FAMILY = "general"

# first matching row wins
TYPE_KEYWORDS = [
    ("invoice", ["invoice", "bill to", "payment due", "subtotal", "amount due"]),
    ("contract", ["agreement", "contract", "termination", "hereby", "parties",
                  "whereas", "governing law", "indemnif", "confidential"]),
    ("social_media", ["http://", "https://", "#", "@", "comment", "tweet", "post",
                      "follower", "retweet", "hashtag", "like", "share"]),
    ("letter", ["subject:", "from:", "to:", "dear", "sincerely", "regards"]),
    ("report", ["executive summary", "table of contents", "findings", "methodology"]),
]
TYPE_LABELS = {
    "contract": "Contract Analysis",
    "invoice": "Invoice Analysis",
    "json": "JSON Data Analysis",
    "json_document": "JSON Data Analysis",
    "social_media": "Social Media Analysis",
    "tabular": "Tabular Data Analysis",
    "markup": "Structured Markup Analysis",
    "email": "Email Analysis",
    "general": "General Document Analysis",
}

# ---------------------------------------------------------------- fixed values: core metrics
CORE_METRICS = ["completeness", "validity", "consistency", "accuracy", "timeliness", "uniqueness"]
CORE_WEIGHTS = {
    "completeness": 0.25,
    "validity": 0.20,
    "consistency": 0.20,
    "accuracy": 0.20,
    "timeliness": 0.10,
    "uniqueness": 0.05,
}
CORE_DESCRIPTIONS = {
    "completeness": "Measures presence of required fields",
    "accuracy": "Validates extracted data correctness",
    "consistency": "Checks logical field relationships",
    "validity": "Ensures format compliance",
    "timeliness": "Assesses data recency",
    "uniqueness": "Identifies duplicate entries",
}
CLEAN_MESSAGES = {
    "completeness": "All required fields are present",
    "accuracy": "All extracted values passed validation",
    "consistency": "All field relationships are logically consistent",
    "validity": "All fields conform to expected formats",
    "timeliness": "All dates and time-sensitive data are current",
    "uniqueness": "No duplicate entries found",
}
REQUIRED_FIELDS = {
    "invoice": ["invoice_number", "invoice_date", "due_date", "vendor_name", "customer_name",
                "total_amount", "line_items", "currency", "billing_address"],
    "contract": ["contract_number", "effective_date", "expiration_date",
                 "party_a", "party_b", "terms", "signatures"],
    "report": ["title", "author", "date", "summary", "sections"],
    "form": ["form_id", "date", "name", "signature"],
    "letter": ["sender", "recipient", "date", "subject", "body"],
}
DEFAULT_REQUIRED_FIELDS = ["date", "name", "title", "reference_number"]
CRITICAL_FIELDS = {
    "invoice": ["invoice_number", "total_amount", "vendor_name", "invoice_date"],
    "contract": ["contract_number", "party_a", "party_b", "effective_date"],
    "report": ["title", "date"],
    "form": ["form_id", "name"],
    "letter": ["sender", "recipient", "date"],
}
DEFAULT_CRITICAL_FIELDS = ["date", "name"]
FORMAT_PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^[\+]?[(]?[0-9]{1,4}[)]?[-\s\./0-9]*$",
    "date": r"\d{1,4}[-/\.]\d{1,2}[-/\.]\d{1,4}",
    "currency_amount": r"^[\$€£¥]?\s?\d{1,3}(,\d{3})*(\.\d{2})?$",
    "postal_code": r"^\d{5}(-\d{4})?$|^[A-Z]{1,2}\d[A-Z\d]?\s?\d[A-Z]{2}$",
    "url": r"^https?://[^\s]+$",
}
# (format, field-name parts); the first row with a matching part decides
FORMAT_BY_FIELD_NAME = [
    ("email", ["email"]),
    ("phone", ["phone", "tel"]),
    ("date", ["date"]),
    ("amount", ["amount", "total", "price", "cost", "fee"]),
    ("url", ["url", "website"]),
]
PLAUSIBLE_NAME_PARTS = ["amount", "total", "price", "cost"]
PLAUSIBLE_MAX = 1_000_000_000
ORDERED_DATE_FIELDS = [
    ("invoice_date", "due_date"),
    ("start_date", "end_date"),
    ("effective_date", "expiration_date"),
    ("created_date", "modified_date"),
]
NAME_ADDRESS_FIELDS = [
    ("vendor_name", "vendor_address"),
    ("customer_name", "billing_address"),
    ("sender", "sender_address"),
]
DATE_NAME_PARTS = ["date", "expir", "valid"]
EXPIRY_NAME_PARTS = ["expir", "valid_until", "due_date"]
AGE_NAME_PARTS = ["invoice_date", "created", "issue_date"]
FUTURE_NAME_PARTS = ["invoice_date", "created", "signed"]
MAX_AGE_DAYS = 730
AMOUNT_TOLERANCE = 0.01
ISSUE_METRIC = {
    "Missing Field": "completeness",
    "Invalid Format": "validity",
    "Inconsistent Value": "consistency",
    "Logical Inconsistency": "consistency",
    "Unverifiable Value": "accuracy",
    "Implausible Value": "accuracy",
    "Expired Date": "timeliness",
    "Outdated Data": "timeliness",
    "Future Date": "timeliness",
    "Duplicate Entry": "uniqueness",
    "Duplicate Value": "uniqueness",
}

# ---------------------------------------------------------------- fixed values: status
GOOD_AT = 90.0
WARNING_AT = 70.0
STATUS_LABELS = {
    "good": "Good Quality",
    "warning": "Moderate Quality",
    "critical": "Critical Issues Detected",
}
STATUS_COLORS = {"good": "#16A34A", "warning": "#EAB308", "critical": "#DC2626"}
PRIMARY_COLOR = "#1E3A8A"
SEVERITIES = ["critical", "warning", "good"]
DETERMINISTIC_SHARE = 0.7

# ---------------------------------------------------------------- fixed values: contract
CLAUSES = {
    "termination": [r"terminat\w+", r"cancel\w+\s+(?:of\s+)?(?:this\s+)?(?:agreement|contract)"],
    "liability": [r"liabilit\w+", r"liable\b"],
    "indemnity": [r"indemnif\w+", r"indemnit\w+", r"hold\s+harmless"],
    "confidentiality": [r"confidential\w+", r"non-disclosure", r"NDA", r"proprietary\s+information"],
    "governing_law": [r"governing\s+law", r"jurisdiction", r"governed\s+by"],
    "dispute_resolution": [r"dispute\s+resolution", r"arbitrat\w+", r"mediat\w+"],
    "force_majeure": [r"force\s+majeure", r"act\s+of\s+god"],
    "payment_terms": [r"payment\s+term", r"payment\s+schedul", r"compensat\w+"],
    "intellectual_property": [r"intellectual\s+property", r"\bIP\b\s+rights", r"copyright"],
    "warranty": [r"warrant\w+", r"guarantee"],
}
SIGNATURE_INDICATORS = {
    "signature_block": r"sign(?:ed|ature)\s*(?:by|:)",
    "witness": r"witness(?:ed|es)?(?:\s+by)?",
    "date_of_signing": r"(?:date|signed)\s*(?:of|on)?\s*(?:signing|execution)",
    "authorized_signatory": r"authoriz\w+\s+sign",
    "party_signatures": r"(?:party\s+[ab]|first\s+party|second\s+party)\s*:?\s*_+",
}
CONTRACT_METADATA = {
    "contract_number": ["contract_number", "contract_id", "agreement_number", "reference_number"],
    "effective_date": ["effective_date", "start_date", "commencement_date"],
    "expiration_date": ["expiration_date", "end_date", "termination_date"],
    "party_a": ["party_a", "first_party", "client", "company"],
    "party_b": ["party_b", "second_party", "vendor", "contractor", "service_provider"],
    "jurisdiction": ["jurisdiction", "governing_law", "applicable_law"],
    "contract_value": ["contract_value", "total_amount", "consideration", "fee"],
}
CONTRACT_RISKS = {
    "Auto-Renewal": [r"auto(?:-|\s+)?renew", r"automatic(?:ally)?\s+renew"],
    "Unlimited Liability": [r"unlimited\s+liabilit", r"no\s+(?:cap|limit)\s+(?:on\s+)?liabilit"],
    "Non-Compete": [r"non-compet\w+", r"restrictive\s+covenant", r"competition\s+restriction"],
    "Penalty Clause": [r"penalty\s+clause", r"liquidated\s+damages", r"penalt(?:y|ies)\s+for"],
    "Unilateral Termination": [r"sole\s+discretion\s+to\s+terminat", r"unilateral(?:ly)?\s+terminat"],
    "Automatic Assignment": [r"assign\w*\s+without\s+(?:prior\s+)?consent"],
    "Indemnify All": [r"indemnif\w+\s+(?:against\s+)?all\s+(?:claims|losses|damages)"],
}

# ---------------------------------------------------------------- fixed values: invoice
INVOICE_FIELDS = {
    "invoice_number": ["invoice_number", "invoice_no", "inv_number", "bill_number"],
    "invoice_date": ["invoice_date", "bill_date", "date_of_invoice"],
    "due_date": ["due_date", "payment_due", "date_due"],
    "vendor_name": ["vendor_name", "supplier", "seller", "biller", "company_name"],
    "customer_name": ["customer_name", "buyer", "bill_to", "client_name"],
    "line_items": ["line_items", "items", "products", "services"],
    "subtotal": ["subtotal", "sub_total", "net_amount"],
    "tax": ["tax", "tax_amount", "gst", "vat", "sales_tax"],
    "total_amount": ["total_amount", "total", "grand_total", "amount_due"],
    "payment_terms": ["payment_terms", "terms", "payment_method"],
    "currency": ["currency", "currency_code"],
    "billing_address": ["billing_address", "bill_to_address", "customer_address"],
}
SUBTOTAL_NAMES = ["subtotal", "sub_total"]
TAX_NAMES = ["tax", "tax_amount", "gst"]
TOTAL_NAMES = ["total_amount", "total", "grand_total"]
ITEM_AMOUNT_NAMES = ["amount", "total", "line_total"]
ITEM_QUANTITY_NAMES = ["quantity", "qty"]
ITEM_PRICE_NAMES = ["unit_price", "price", "rate"]

# ---------------------------------------------------------------- fixed values: JSON
JSON_DATE_PAIRS = [
    ("start_date", "end_date"), ("created_at", "updated_at"),
    ("start", "end"), ("from", "to"),
    ("created", "modified"), ("begin_date", "end_date"),
]
JSON_COMPONENT_PARTS = ["amount", "price", "cost", "value", "subtotal"]

# ---------------------------------------------------------------- fixed values: social media
SLANG_PATTERNS = [
    r"\b(lol|lmao|brb|tbh|imo|imho|smh|fwiw|rofl|omg|wtf|idk|ngl)\b",
    r"\b(u|ur|r|b4|2day|2moro|2nite|gr8|m8|h8|w8|l8r)\b",
    r"\b(gonna|wanna|gotta|kinda|sorta|dunno|lemme)\b",
]
EMOJI_PATTERN = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}"
    r"\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
)
OFFENSIVE_PATTERNS = {
    "profanity": [
        r"\b(damn|hell|crap|suck|stupid|idiot|dumb|moron|loser)\b",
        r"\b(shut\s+up|piss\s+off)\b",
    ],
    "hate_speech": [
        r"\b(hate\s+(?:you|them|all)|go\s+die|kill\s+yourself)\b",
        r"\b(worthless|pathetic|disgusting)\s+(?:people|person|human)",
    ],
    "threats": [
        r"\b((?:i(?:'ll|m going to|will))\s+(?:kill|hurt|destroy|find)\s+(?:you|them))\b",
        r"\b(watch\s+your\s+back|you(?:'ll|will)\s+(?:pay|regret))\b",
    ],
    "discriminatory": [
        r"\b(go\s+back\s+to|you\s+people|your\s+kind)\b",
    ],
}
PROMO_PATTERNS = [
    r"\b(buy\s+now|limited\s+(?:time|offer)|act\s+now|click\s+(?:here|below))\b",
    r"\b(free\s+(?:gift|trial|offer)|discount\s+code|promo\s+code|coupon)\b",
    r"\b(subscribe|follow\s+(?:us|me)|retweet|share\s+this)\b",
    r"\b(earn\s+money|make\s+\$?\d+|work\s+from\s+home|passive\s+income)\b",
    r"\b(DM\s+(?:me|us)|link\s+in\s+bio|check\s+out)\b",
]

# ---------------------------------------------------------------- fixed values: tabular
NULL_WORDS = ["null", "none", "na", "n/a", "nan", "", "nil", "undefined", "-"]
DATE_LIKE_PATTERNS = [
    r"\d{4}-\d{2}-\d{2}",
    r"\d{2}/\d{2}/\d{4}",
    r"\d{2}-\d{2}-\d{4}",
    r"\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)",
]

# ---------------------------------------------------------------- fixed values: markup
VOID_TAGS = ["br", "hr", "img", "input", "meta", "link", "area", "base",
             "col", "embed", "source", "track", "wbr"]
REQUIRED_ATTRIBUTES = [("img", "alt"), ("a", "href"), ("input", "type"), ("form", "action")]
ENCODING_ARTIFACTS = [
    (r"Ã¢|Ã©|Ã¼|Â©|Â®|Ã±", "UTF-8 mojibake detected"),
    (r"&#\d{4,6};", "Excessive numeric entities"),
    (r"&amp;amp;|&amp;lt;|&amp;gt;", "Double-escaped entities"),
]

# ---------------------------------------------------------------- fixed values: email
REQUIRED_HEADERS = ["From", "To", "Subject", "Date"]
OPTIONAL_HEADERS = ["Message-ID", "MIME-Version", "Content-Type"]
ADDRESS_HEADERS = ["From", "To", "Cc", "Bcc"]
ADDRESS_PATTERN = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
DISCLAIMERS = ["confidential", "disclaimer", "do not reply", "unsubscribe"]
ATTACHMENT_WORDS = r"\b(?:attach(?:ed|ment|ing)?|enclosed|find\s+attached|PFA|please\s+find)\b"

# ---------------------------------------------------------------- fixed values: general
HEADING_PATTERN = r"(?:^|\n)(?:#{1,6}\s|[A-Z][A-Z\s]{3,}:?\s*$|(?:\d+\.)+\s)"
LIST_PATTERN = r"^[\s]*[-*•]\s+\S|^[\s]*\d+[.)]\s+\S"
KEY_VALUE_PATTERN = r"^\s*[\w\s]+:\s+\S"
INTRO_PATTERNS = [r"\bintroduction\b", r"\boverview\b", r"\bpurpose\b", r"\babstract\b",
                  r"\bsummary\b", r"\bbackground\b", r"\bdear\s+\w+"]
BODY_PATTERN = r"(?:^|\n)(?:\d+\.\s+|#{2,}\s|[A-Z][a-z]+\s+[A-Z])"
CONCLUSION_PATTERNS = [r"\bconclusion\b", r"\brecommendation\b", r"\bnext\s+steps\b",
                       r"\baction\s+items\b", r"\bsincerely\b", r"\bregards\b", r"\bthanks\b"]
STOP_WORDS = [
    "the", "and", "for", "are", "but", "not", "you", "all",
    "can", "had", "her", "was", "one", "our", "out", "has",
    "his", "how", "its", "may", "new", "now", "old", "see",
    "way", "who", "did", "get", "let", "say", "she", "too",
    "use", "this", "that", "with", "have", "from", "will",
    "been", "each", "make", "like", "than", "them", "then",
    "what", "when", "some", "into",
]
SYLLABLE_STRIP = ".,;:!?\"'()[]{}"

# ---------------------------------------------------------------- fixed values: type metrics
# family -> [(metric name, key, weight, description)] in reporting order
TYPE_METRICS = {
    "contract": [
        ("Clause Completeness", "clause_completeness", 0.30, "Checks for presence of standard contract clauses"),
        ("Signature Presence", "signature_presence", 0.25, "Detects signature blocks and signing indicators"),
        ("Metadata Completeness", "metadata_completeness", 0.25, "Checks for essential contract metadata"),
        ("Risk Clause Detection", "risk_clause_detection", 0.20, "Flags potentially risky contract clauses"),
    ],
    "invoice": [
        ("Field Completeness", "field_completeness", 0.35, "Checks for invoice-specific required fields"),
        ("OCR Confidence", "ocr_confidence", 0.30, "Assesses text extraction confidence for image-based documents"),
        ("Amount Consistency", "amount_consistency", 0.35, "Verifies arithmetic consistency of invoice amounts"),
    ],
    "json": [
        ("Schema Compliance", "schema_compliance", 0.25, "Validates JSON structural consistency"),
        ("Type Validation", "type_validation", 0.25, "Validates that values match expected data types"),
        ("Cross-Field Consistency", "cross_field_consistency", 0.25, "Validates logical relationships between fields"),
        ("Schema Drift Rate", "schema_drift_rate", 0.25, "Detects structural drift in JSON data"),
    ],
    "social_media": [
        ("Language Consistency", "language_consistency", 0.30, "Measures language consistency and formality"),
        ("Offensive Rate", "offensive_rate", 0.35, "Detects offensive or toxic content"),
        ("Spam Detection", "spam_detection", 0.35, "Flags spam indicators in social media content"),
    ],
    "tabular": [
        ("Row Completeness", "row_completeness", 0.25, "Percentage of rows with no empty cells"),
        ("Column Type Consistency", "column_type_consistency", 0.25, "Checks if column values have consistent types"),
        ("Header Quality", "header_quality", 0.25, "Evaluates column header quality"),
        ("Null/Empty Ratio", "null_empty_ratio", 0.25, "Measures percentage of non-null cells"),
    ],
    "markup": [
        ("Tag Validity", "tag_validity", 0.30, "Checks for well-formed tag structure"),
        ("Nesting Depth", "nesting_depth", 0.20, "Checks for excessive tag nesting"),
        ("Attribute Completeness", "attribute_completeness", 0.30, "Checks for required attributes on elements"),
        ("Encoding Consistency", "encoding_consistency", 0.20, "Checks for consistent character encoding"),
    ],
    "email": [
        ("Header Completeness", "header_completeness", 0.30, "Checks for essential email headers"),
        ("Recipient Validation", "recipient_validation", 0.25, "Validates email addresses in headers"),
        ("Body Quality", "body_quality", 0.25, "Evaluates email body content quality"),
        ("Attachment Check", "attachment_check", 0.20, "Checks attachment references vs actual attachments"),
    ],
    "general": [
        ("Structure Quality", "structure_quality", 0.25, "Evaluates structural diversity and organization"),
        ("Readability Score", "readability_score", 0.25, "Measures text readability (Flesch Reading Ease)"),
        ("Section Completeness", "section_completeness", 0.25, "Detects intro, body, and conclusion sections"),
        ("Keyword Density", "keyword_density", 0.25, "Checks for unusual keyword repetition"),
    ],
}

# ---------------------------------------------------------------- fixed values: insights
# (scope, metric, from score, below score, severity, issue, impact, recommendation)
# scope "core" applies to every document, any other scope to that document type.
INSIGHT_RULES = [
    ("core", "completeness", 0.0, 70.0, "critical",
     "Significant number of required fields are missing.",
     "Downstream systems may fail or produce incorrect results due to missing data.",
     "Review extraction pipeline and ensure all required fields are captured."),
    ("core", "completeness", 70.0, 90.0, "warning",
     "Some required fields are missing from the document.",
     "Data completeness may affect reporting accuracy.",
     "Verify that all expected fields are present before processing."),
    ("core", "validity", 0.0, 70.0, "critical",
     "Multiple field values do not conform to expected formats.",
     "Invalid data formats can cause processing errors and data corruption.",
     "Implement format validation rules during data ingestion."),
    ("core", "validity", 70.0, 90.0, "warning",
     "Some fields have minor format inconsistencies.",
     "May cause parsing issues in downstream systems.",
     "Standardize date, phone, and email formats across the pipeline."),
    ("core", "consistency", 0.0, 70.0, "critical",
     "Logical inconsistencies detected between related fields.",
     "Cross-field relationships are broken, compromising data integrity.",
     "Add cross-field validation rules to catch arithmetic and logical errors."),
    ("core", "accuracy", 0.0, 70.0, "critical",
     "Extracted values could not be verified against source text.",
     "Unverifiable data reduces confidence in extracted information.",
     "Review extraction accuracy and consider re-processing with improved methods."),
    ("core", "timeliness", 0.0, 70.0, "warning",
     "Document contains expired or outdated date information.",
     "Stale data may lead to compliance violations or incorrect decisions.",
     "Update expired dates and establish a document refresh cadence."),
    ("core", "uniqueness", 0.0, 90.0, "warning",
     "Duplicate entries detected in document data.",
     "Duplicate records may distort reporting and analytics results.",
     "Apply deduplication checks during data ingestion."),
    ("contract", "Signature Presence", 0.0, 50.0, "critical",
     "Contract signature is missing or incomplete.",
     "Contract may not be legally enforceable without proper signatures.",
     "Ensure all parties have signed the document with authorized signatories."),
    ("contract", "Clause Completeness", 0.0, 70.0, "critical",
     "Several standard contract clauses are missing.",
     "Missing clauses may leave parties unprotected in disputes.",
     "Add standard clauses: termination, liability, confidentiality, governing law."),
    ("contract", "Risk Clause Detection", 0.0, 70.0, "critical",
     "Multiple risky clauses detected (e.g., auto-renewal, unlimited liability).",
     "Risky terms may expose the organization to financial or legal liability.",
     "Review flagged clauses with legal counsel before execution."),
    ("contract", "Metadata Completeness", 0.0, 80.0, "warning",
     "Contract metadata is incomplete (missing dates, parties, or reference numbers).",
     "Incomplete metadata reduces contract traceability and searchability.",
     "Ensure contract number, effective/expiration dates, and party names are present."),
    ("invoice", "Amount Consistency", 0.0, 100.0, "critical",
     "Invoice subtotal and tax do not match the total amount.",
     "Financial discrepancies may lead to payment errors or audit findings.",
     "Validate invoice arithmetic (subtotal + tax = total) during ingestion."),
    ("invoice", "OCR Confidence", 0.0, 80.0, "warning",
     "OCR text extraction confidence is low.",
     "Extracted text may contain errors affecting all downstream quality checks.",
     "Use higher-quality scans or consider manual verification for critical fields."),
    ("invoice", "Field Completeness", 0.0, 80.0, "warning",
     "Key invoice fields are missing (e.g., invoice number, due date, payment terms).",
     "Incomplete invoices cannot be processed for payment.",
     "Ensure all mandatory invoice fields are captured before submission."),
    ("json", "Type Validation", 0.0, 100.0, "warning",
     "Data type mismatches detected (e.g., numbers stored as strings).",
     "Financial analytics may produce incorrect totals due to type coercion.",
     "Convert numeric fields to proper data types before analytics."),
    ("json", "Schema Compliance", 0.0, 90.0, "critical",
     "JSON records do not conform to a consistent schema.",
     "Inconsistent structure may cause data pipeline failures.",
     "Enforce schema validation during data ingestion."),
    ("json", "Schema Drift Rate", 0.0, 80.0, "warning",
     "Schema drift detected — records have inconsistent key structures.",
     "Structural drift can break downstream data consumers.",
     "Monitor schema changes and version your data contracts."),
    ("json", "Cross-Field Consistency", 0.0, 90.0, "warning",
     "Logical inconsistencies between JSON fields detected.",
     "Cross-field errors may produce incorrect aggregations.",
     "Add cross-field validation rules to your data pipeline."),
    ("social_media", "Offensive Rate", 0.0, 80.0, "critical",
     "Offensive or toxic content detected in the data.",
     "Unfiltered offensive content may cause brand damage or compliance issues.",
     "Implement content moderation filters before public-facing use."),
    ("social_media", "Spam Detection", 0.0, 80.0, "warning",
     "Spam indicators detected (excessive links, promotional language).",
     "Spam data can skew analytics and degrade data quality.",
     "Apply spam filters and remove promotional content from datasets."),
    ("social_media", "Language Consistency", 0.0, 80.0, "warning",
     "Inconsistent language use detected (high slang or mixed-language content).",
     "Language inconsistency may affect NLP processing and sentiment analysis.",
     "Normalize text and filter by target language before analysis."),
]
# document type spellings that use each scope's rules
INSIGHT_SCOPES = {
    "contract": ["contract"],
    "invoice": ["invoice"],
    "json": ["json", "json_document", "json_data"],
    "social_media": ["social_media", "social media", "tweet", "post"],
}
NO_RISK_TEXT = "No significant quality risks detected. Document meets quality standards."
FALLBACK_SUMMARY = "LLM analysis was unavailable. Scores are based on deterministic checks only."
FALLBACK_RISK = "Unable to perform AI-assisted risk assessment."
FALLBACK_RECOMMENDATIONS = [
    "Configure scoring-service credentials for full analysis.",
    "Review document manually for completeness.",
]

# ---------------------------------------------------------------- fixed values: prototype rules
PROTO_CLAUSES = ["parties", "term", "termination", "payment", "liability", "confidentiality"]
PROTO_META = ["author", "date", "version"]
PROTO_RISKS = ["unlimited liability", "automatic renewal", "exclusive"]
PROTO_INVOICE_WORDS = ["invoice", "vendor", "date", "total"]
PROTO_RECORD_KEYS = ["order_id", "amount", "tax", "total"]
PROTO_OCR = 92.0
PROTO_INSIGHTS = [
    ("JSON", "Type Validation", 100.0,
     "Datatype mismatch detected in 'amount'.",
     "Financial analytics may produce incorrect totals.",
     "Convert amount column to numeric datatype before analytics."),
    ("JSON", "Uniqueness", 100.0,
     "Duplicate order_id values detected.",
     "Duplicate records may distort reporting results.",
     "Apply primary key validation during ingestion."),
    ("Invoice", "Amount Consistency", 100.0,
     "Invoice subtotal and tax do not match total.",
     "Financial discrepancies may occur.",
     "Validate invoice arithmetic during ingestion."),
    ("Contract", "Signature Presence", 0.0,
     "Contract signature missing.",
     "Contract may not be legally enforceable.",
     "Ensure authorized signature is present."),
]
PROTO_CLEAN = "Document quality appears consistent."

# ---------------------------------------------------------------- own values
# Function words per language for the line-level language share.
LANGUAGE_PROFILES = {
    "en": ["the", "and", "of", "to", "in", "is", "that", "for", "on", "with", "as", "was", "are", "be", "by", "at"],
    "fr": ["le", "la", "les", "et", "des", "de", "un", "une", "est", "que", "qui", "dans", "pour", "pas", "sur", "du"],
    "de": ["der", "die", "und", "das", "ist", "nicht", "ein", "eine", "mit", "von", "zu", "den", "auf", "im", "dem", "sich"],
    "es": ["el", "los", "las", "y", "es", "una", "por", "con", "para", "del", "se", "no", "su", "al", "como", "lo"],
}
