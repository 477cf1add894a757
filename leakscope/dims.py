"""Fixed values.

Everything in this module is a constant that results depend on: regular expressions, word lists, look-up tables and
thresholds. They are kept in natural order, in one place, and hold no logic.
"""
from __future__ import annotations

# --- detection patterns (fixed values; position is the tie-break order) ------------------------------------------

LIVE_PATTERNS: list[tuple[str, str]] = [
    ("AADHAAR", r"(?<!\d)[1-9]\d{3}[\s\-]?\d{4}[\s\-]?\d{4}(?!\d)"),
    ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"),
    ("PASSPORT_IN", r"\b[A-PR-WY][1-9]\d{6}\b"),
    ("VOTER_ID", r"\b[A-Z]{3}[0-9]{7}\b"),
    ("DL_IN", r"\b[A-Z]{2}[0-9]{2}\s?[0-9]{11}\b"),
    ("SSN", r"(?<![\d.])\b\d{3}-\d{2}-\d{4}\b(?![\d.])"),
    ("CREDIT_CARD", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|6011[0-9]{12}|3[47][0-9]{13})\b"),
    ("IFSC", r"\b[A-Z]{4}0[A-Z0-9]{6}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("PHONE", r"(?<!\d)(\+91[-\s]?)?[6-9]\d{9}(?!\d)"),
]

GSTIN_PATTERN = r"\b[0-3][0-9][A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b"
UPI_PATTERN = r"\b[a-zA-Z0-9.\-_]{2,40}@[a-zA-Z]{2,64}\b"
ABHA_PATTERN = r"\b\d{2}-\d{4}-\d{4}-\d{4}\b"

# GSTIN follows PAN, the payment and health identifiers close the list.
EXTENDED_PATTERNS: list[tuple[str, str]] = [
    ("AADHAAR", r"(?<!\d)[1-9]\d{3}[\s\-]?\d{4}[\s\-]?\d{4}(?!\d)"),
    ("PAN", r"\b[A-Z]{5}[0-9]{4}[A-Z]\b"),
    ("GSTIN", GSTIN_PATTERN),
    ("PASSPORT_IN", r"\b[A-PR-WY][1-9]\d{6}\b"),
    ("VOTER_ID", r"\b[A-Z]{3}[0-9]{7}\b"),
    ("DL_IN", r"\b[A-Z]{2}[0-9]{2}\s?[0-9]{11}\b"),
    ("SSN", r"(?<![\d.])\b\d{3}-\d{2}-\d{4}\b(?![\d.])"),
    ("CREDIT_CARD", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|6011[0-9]{12}|3[47][0-9]{13})\b"),
    ("IFSC", r"\b[A-Z]{4}0[A-Z0-9]{6}\b"),
    ("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"),
    ("PHONE", r"(?<!\d)(\+91[-\s]?)?[6-9]\d{9}(?!\d)"),
    ("UPI", UPI_PATTERN),
    ("ABHA", ABHA_PATTERN),
]

# Payment handles the strict profile accepts.
STRICT_UPI_HANDLES = [
    "okaxis", "oksbi", "okicici", "okhdfcbank", "ybl", "ibl", "paytm", "apl", "jupiteraxis", "fam", "naviaxis", "axl",
    "barodampay", "cnrb", "federal", "kotak", "rbl", "upi", "icici", "sbi", "hdfc", "airtel", "waicici",
]
# Payment handles the structural check knows (it accepts others too).
KNOWN_UPI_HANDLES = [
    "okaxis", "oksbi", "okicici", "okhdfcbank", "ybl", "ibl", "paytm", "apl", "jupiteraxis", "fam", "naviaxis", "axl",
    "barodampay", "cnrb", "federal", "kotak", "rbl", "upi", "icici", "sbi", "hdfc",
]

STRICT_AADHAAR_GROUPED = r"(?<!\d)\d{4}[ \-]\d{4}[ \-]\d{4}(?!\d)"
STRICT_AADHAAR_SOLID = r"(?<![+\d])\d{12}(?!\d)"
STRICT_PHONE_PREFIXED = r"(?<![0-9])(?:\+91|91)[\s\-]?([6-9]\d{9})(?!\d)"
STRICT_PHONE_BARE = r"(?<!\d)([6-9]\d{9})(?!\d)"
STRICT_CARD_GROUPED = r"\b\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}\b"
STRICT_CARD_SOLID = r"(?<!\d)\d{16}(?!\d)"
STRICT_PASSPORT = r"\b[A-PR-WY][1-9]\d{6}\b"

# --- context signals (fixed values, all case-insensitive) --------------------------------------------------------

OWNERSHIP = r"\b(my|his|her|your|their|our|client'?s?|customer'?s?|user'?s?)\b"
MASKED_VALUE = r"[xX\*]{3,}|xxxx|\*{3,}"
DUMMY_CONTEXT = (
    r"\b(dummy|fake|test\s+data|test\s+card|sample|demo|placeholder|for\s+illustration|not\s+real|fictitious|"
    r"mock[\s\-]?up|documentation\s+example|format\s+example|use\s+\S+\s+as\s+a)\b"
)
DUMMY_CONTEXT_BROAD = (
    r"\b(dummy|fake|test|sample|demo|placeholder|for\s+illustration|not\s+real|fictitious|mock|"
    r"documentation\s+example)\b"
)
TECHNICAL_CONTEXT = (
    r"\b(dimensions?|ratios?|resolutions?|versions?|v\d+|subnets?|ip\s+address|weights?|heights?|widths?|pixels?|"
    r"px|cm|mm|inches?|sizes?|configs?|coordinates?|measurements?)\b"
)
PII_KEYWORDS = (
    r"\b(aadhaar|aadhar|pan\b|kyc|passport|voter\s?id|driving\s?licen[cs]e|credit\s?card|debit\s?card|"
    r"bank\s?account|ifsc|ssn|social\s?security|phone\s?number|mobile\s?number|whatsapp|email\s+address|"
    r"my\s+email|email\s+was|email\s+got|confidential|leaked|disclosed|exposed|accidentally|mistakenly)\b"
)
AADHAAR_VETO = r"\b(account|a/c|card|dimension|size|px|cm|mm|inches)\b"
STRICT_PHONE_CONTEXT = r"\b(phone|mobile|mob|ph|cell|contact|whatsapp|call|sms|tel|no\.?|number)\b"
STRICT_AADHAAR_CONTEXT = r"\b(aadhaar|aadhar|adhar|uidai|uid|enrolment|enrollment)\b"
STRICT_CONTEXT_WORDS: dict[str, list[str]] = {
    "IN_PAN": ["pan", "permanent account", "income tax", "tds", "form 16", "pan card", "pancard", "pan no",
               "pan number", "taxpayer"],
    "IN_GSTIN": ["gst", "gstin", "goods and service", "tax invoice", "gstin no", "gst number", "gst registration"],
    "IN_UPI": ["upi", "gpay", "phonepe", "paytm", "bhim", "transfer", "vpa", "pay"],
    "IN_ABHA": ["abha", "ayushman", "health id", "uhid", "abdm", "health account"],
    "IN_CARD": ["card", "visa", "mastercard", "rupay", "maestro", "cvv", "cvc", "expiry", "exp date", "debit",
                "credit", "atm"],
    "IN_PASSPORT": ["passport", "travel document", "republic of india", "ministry of external affairs",
                    "passport no", "passport number"],
    "EMAIL_ADDRESS": ["email"],
}

# --- scores (fixed values) ---------------------------------------------------------------------------------------

FAST_BASE, FAST_KEYWORD = "0.650", "0.750"
KEYWORD_FLOOR = "0.700"
CARD_BASE, NO_SENTENCE_BASE = "0.870", "0.650"
LOW_RISK_LIMIT, LOW_RISK_CAP = "0.28", "0.520"
OWNERSHIP_BOOST, PERSON_BOOST = "0.100", "0.070"
CONFIRMED_AT, PROBABLE_AT = "0.820", "0.580"

STRICT_BASE = {"IN_PAN": "0.750", "IN_GSTIN": "0.800", "IN_UPI": "0.880", "IN_ABHA": "0.880", "IN_PASSPORT": "0.720"}
STRICT_VALIDATED = {"IN_PAN": "0.900", "IN_GSTIN": "0.880", "IN_CARD": "0.850", "IN_ABHA": "0.900"}
STRICT_THRESHOLD = "0.500"

# Label vocabularies of the two optional classifiers.
HIGH_RISK_LABELS = [
    "someone's real personal information being shared or exposed",
    "private data accidentally or intentionally disclosed",
    "sensitive information belonging to a real individual",
]
MID_RISK_LABELS = ["information that may or may not be real personal data"]
LOW_RISK_LABELS = [
    "a fictional, fake, or made-up example used for illustration",
    "masked, redacted, or anonymised data",
    "technical documentation or format specification",
]
FAKE_LABELS = ["test or dummy data", "code variable or identifier", "example or sample data"]
FAKE_KEYWORDS = [
    "test", "dummy", "fake", "example", "sample", "mock", "placeholder", "lorem", "ipsum", "foobar", "john doe",
    "jane doe", "xxx", "todo", "fixture", "seed", "factory", "stub", "demo", "temp", "tmp",
]
FAKE_ELIGIBLE = ["IN_AADHAAR", "IN_PAN", "IN_GSTIN", "IN_CARD", "PERSON", "IN_PASSPORT", "IN_ABHA", "IN_UPI"]

# --- type dimension (fixed values) -------------------------------------------------------------------------------

TYPE_ALIAS = {
    "AADHAAR": "IN_AADHAAR", "PAN": "IN_PAN", "GSTIN": "IN_GSTIN", "PASSPORT_IN": "IN_PASSPORT",
    "CREDIT_CARD": "IN_CARD", "UPI": "IN_UPI", "ABHA": "IN_ABHA", "PHONE": "PHONE_NUMBER_INDIA",
    "EMAIL": "EMAIL_ADDRESS",
}
RISK = {
    "AADHAAR": "Critical", "PAN": "High", "GSTIN": "High", "PASSPORT_IN": "High", "VOTER_ID": "Medium",
    "DL_IN": "Medium", "SSN": "Critical", "CREDIT_CARD": "Critical", "IFSC": "Low", "EMAIL": "Low",
    "PHONE": "Medium", "UPI": "Medium", "ABHA": "High",
    "IN_AADHAAR": "Critical", "IN_PAN": "High", "IN_GSTIN": "High", "IN_CARD": "Critical", "IN_PASSPORT": "High",
    "IN_ABHA": "High", "IN_UPI": "Medium", "PHONE_NUMBER_INDIA": "Medium", "EMAIL_ADDRESS": "Low",
}
RISK_LEVELS = ["Critical", "High", "Medium", "Low"]
SENSITIVITY = {
    "IN_AADHAAR": "9.0", "IN_PASSPORT": "8.5", "IN_PAN": "8.0", "IN_GSTIN": "6.5", "IN_CARD": "9.5", "IN_UPI": "5.5",
    "IN_ABHA": "8.0", "PHONE_NUMBER_INDIA": "4.5", "PHONE_NUMBER": "4.0", "EMAIL_ADDRESS": "3.0", "PERSON": "2.5",
}
DEFAULT_SENSITIVITY = "2.0"
TOXIC_COMBOS: list[tuple[list[str], str, str]] = [
    (["IN_AADHAAR", "IN_PAN", "PHONE_NUMBER_INDIA"], "1.90", "Full KYC triad"),
    (["IN_CARD", "IN_AADHAAR"], "1.85", "Card + Aadhaar"),
    (["IN_CARD", "IN_PAN"], "1.75", "Card + PAN"),
    (["IN_UPI", "PHONE_NUMBER_INDIA"], "1.60", "UPI + Phone"),
    (["IN_AADHAAR", "IN_PAN"], "1.55", "Aadhaar + PAN"),
    (["IN_ABHA", "IN_AADHAAR"], "1.50", "ABHA + Aadhaar"),
    (["EMAIL_ADDRESS", "PHONE_NUMBER_INDIA"], "1.30", "Email + Phone"),
    (["PERSON", "IN_AADHAAR"], "1.25", "Name + Aadhaar"),
    (["PERSON", "IN_PAN"], "1.20", "Name + PAN"),
]
EXPOSURE_RADIUS = {"github_public": "1.30", "pastebin": "1.15", "gitlab_public": "1.25", "unknown": "1.00"}
DISPLAY_NAMES = {
    "IN_AADHAAR": "Aadhaar Number", "IN_PAN": "PAN Card", "IN_GSTIN": "GSTIN", "IN_CARD": "Card Number",
    "IN_UPI": "UPI ID", "IN_ABHA": "ABHA Health ID", "IN_PASSPORT": "Indian Passport",
    "PHONE_NUMBER_INDIA": "Indian Phone", "EMAIL_ADDRESS": "Email Address", "PERSON": "Person Name",
}
ESS_BANDS = [("9.0", "CRITICAL", "#ff2d2d"), ("7.0", "HIGH", "#ff6b00"), ("5.0", "MEDIUM", "#ffc107"),
             ("2.5", "LOW", "#4fc3f7")]
ESS_FLOOR = ("INFO", "#aaaaaa")
TIER_BANDS = [("9.0", "Critical"), ("7.0", "High"), ("5.0", "Medium"), ("2.5", "Low")]
TIER_FLOOR = "Info"
RISK_COLORS = {"Critical": "#ff2d2d", "High": "#ff6b00", "Medium": "#ffc107", "Low": "#4fc3f7"}

# --- files (fixed values) ----------------------------------------------------------------------------------------

TEXT_SUFFIXES = [
    ".py", ".js", ".ts", ".jsx", ".tsx", ".json", ".yaml", ".yml", ".toml", ".ini", ".cfg", ".conf", ".env",
    ".env.example", ".env.local", ".env.dev", ".env.prod", ".md", ".txt", ".csv", ".sql", ".sh", ".bash", ".zsh",
    ".xml", ".html", ".htm", ".log", ".rb", ".php", ".java", ".go", ".rs", ".cs", ".properties", ".gradle", ".pom",
    ".tf", ".tfvars",
]
OCR_SUFFIXES = [".png", ".jpg", ".jpeg", ".pdf", ".bmp", ".tiff", ".webp"]
SKIP_DIRS = [
    "node_modules", ".git", "dist", "build", "__pycache__", ".venv", "venv", ".mypy_cache", ".pytest_cache",
    "coverage", "vendor", "target", "bin", "obj", ".next", ".nuxt", "static", "assets", "public", "fonts", "images",
]
MAX_CONTENT_BYTES = 500_000
MAX_LISTED_BYTES = 1_000_000
SKIP_FILENAME = (
    r"(package-lock\.json|yarn\.lock|poetry\.lock|Pipfile\.lock|composer\.lock|Gemfile\.lock|\.min\.js|\.min\.css"
    r"|\.map$|/__pycache__/|/\.git/)"
)
CHUNK_CHARS = 300_000
# Characters that a piece of a long text also sees of its neighbours.
CHUNK_OVERLAP = 10_000

# --- pastes (fixed values) ---------------------------------------------------------------------------------------

PASTE_HOST = "https://pastebin.com"
PASTE_KEY = r"^/([A-Za-z0-9]{8})(?:\?.*)?$"
PASTE_NAV_PATHS = [
    "/archive", "/login", "/signup", "/faq", "/tools", "/doc_api", "/languages", "/night_mode", "/pro", "/contact",
    "/dmca", "/report-abuse", "/news", "/doc_scraping_api", "/doc_privacy_statement", "/doc_cookies_policy",
    "/doc_terms_of_service", "/doc_security_disclosure",
]
DEMO_PASTE_IDS = ["QM9dUJUK", "Z22PGEq8", "u5pc8MJ8", "Mqqg16H2", "aV9H9xCr", "cgGchv3S", "0WZrjyqf", "YKNJdHdM"]

# --- identity documents (fixed values) ---------------------------------------------------------------------------

KYC_PHRASES = ["GOVERNMENT OF INDIA", "INDIAN PASSPORT", "AADHAAR CARD", "PERMANENT ACCOUNT NUMBER",
               "ELECTION COMMISSION", "DRIVING LICENCE"]
KYC_MARKER_LINE = "[KYC_DOCUMENT_DETECTED]"
DOCUMENT_MARKERS: dict[str, list[str]] = {
    "aadhaar": ["unique identification authority", "uidai", "aadhaar", "aadhar", "adhar", "enrolment",
                "government of india"],
    "pan": ["income tax department", "permanent account number", "govt. of india", "government of india",
            "pan card"],
    "passport": ["republic of india", "passport", "ministry of external affairs", "place of birth", "date of issue",
                 "date of expiry"],
    "driving_licence": ["driving licence", "transport department", "motor vehicles", "valid till", "licence no"],
    "voter_id": ["election commission", "electors photo identity", "epic no", "voter"],
}

# --- validators (fixed values) -----------------------------------------------------------------------------------

PAN_HOLDER_LETTERS = "CPHABGJLFTE"
CODE_PUNCTUATION = r"[(\[.<=>{}/\\]"
CODE_KEYWORDS = ["def", "class", "import", "return", "lambda", "async", "await", "yield", "pass", "raise", "except",
                 "finally", "None", "True", "False", "self", "cls"]
# Verhoeff: dihedral group multiplication and the position permutation.
VERHOEFF_D = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 2, 3, 4, 0, 6, 7, 8, 9, 5], [2, 3, 4, 0, 1, 7, 8, 9, 5, 6],
    [3, 4, 0, 1, 2, 8, 9, 5, 6, 7], [4, 0, 1, 2, 3, 9, 5, 6, 7, 8], [5, 9, 8, 7, 6, 0, 4, 3, 2, 1],
    [6, 5, 9, 8, 7, 1, 0, 4, 3, 2], [7, 6, 5, 9, 8, 2, 1, 0, 4, 3], [8, 7, 6, 5, 9, 3, 2, 1, 0, 4],
    [9, 8, 7, 6, 5, 4, 3, 2, 1, 0],
]
VERHOEFF_P = [
    [0, 1, 2, 3, 4, 5, 6, 7, 8, 9], [1, 5, 7, 6, 2, 8, 3, 0, 9, 4], [5, 8, 0, 3, 7, 9, 6, 1, 4, 2],
    [8, 9, 1, 6, 0, 4, 3, 5, 2, 7], [9, 4, 5, 3, 1, 2, 6, 8, 7, 0], [4, 2, 8, 6, 5, 7, 3, 9, 0, 1],
    [2, 7, 9, 3, 8, 0, 6, 4, 1, 5], [7, 0, 4, 6, 9, 1, 3, 2, 5, 8],
]

# --- social posts (fixed values) ---------------------------------------------------------------------------------

REMOVED_BODIES = ["[deleted]", "[removed]"]
IMAGE_URL = r"\.(jpg|jpeg|png|webp)$"
