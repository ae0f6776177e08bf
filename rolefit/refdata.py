"""Reference values.

Everything in this file is a FIXED VALUE: results are only right when these lists, numbers and patterns hold
exactly these contents. They are plain Python constants that the operators turn into literal Catalyst
expressions, so none of them is ever a table that could grow.
"""

# --- admission -------------------------------------------------------------------------------------------------
PDF = "application/pdf"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
MSWORD = "application/msword"
ALLOWED_TYPES = {
    "resume": (PDF, DOCX, MSWORD),
    "jd": (PDF, DOCX, MSWORD, "text/plain"),
    "template": (DOCX,),
}
MAX_FILE_BYTES = 10 * 1024 * 1024
MIN_TEXT_CHARS = {"resume": 50, "jd": 30}
ENGLISH_MARKERS = ("experience", "education", "skills", "summary", "work", "project")

# --- extraction patterns (Java regex dialect) --------------------------------------------------------------------
EMAIL_RE = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
PHONE_RE = r"(?U)\+?\d[\d\s\-().]{8,15}\d"
LINKEDIN_RE = r"(?iU)linkedin\.com/in/[\w\-]+"
GITHUB_RE = r"(?iU)github\.com/[\w\-]+"
YEARS_STATED_RE = r"(?iU)(\d+(?:\.\d+)?)\s*\+?\s*years?\s*(?:of\s+)?(?:experience|exp)"
MONTH_YEAR_RE = (
    r"(?iU)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|January|February|March|"
    r"April|June|July|August|September|October|November|December)\s+(\d{4})"
)
JD_RANGE_RE = r"(?iU)(\d+)\s*[-–to]+\s*(\d+)\s*years?"
JD_STATED_RE = r"(?iU)(\d+)\+?\s*years?\s*(?:of\s+)?(?:experience|exp)"
JD_MINIMUM_RE = r"(?iU)(?:minimum|min\.?|at least)\s*(\d+)\s*years?"
JD_OPEN_RANGE_YEARS = 3
TITLE_SCAN_LINES = 5
TITLE_MAX_CHARS = 80
UNKNOWN_TITLE = "Unknown Position"
UNKNOWN_NAME = "Unknown"

# --- label vocabularies ------------------------------------------------------------------------------------------
SENIORITY_LEVELS = ("intern", "junior", "mid", "senior", "lead", "manager", "director")
SENIORITY_SUBSTRING_ORDER = ("director", "manager", "lead", "senior", "mid", "junior", "intern")
SENIORITY_ALIASES = {
    "entry": "junior", "entry-level": "junior", "entry level": "junior", "graduate": "junior",
    "associate": "junior", "intermediate": "mid", "experienced": "mid", "mid-level": "mid", "mid level": "mid",
    "principal": "lead", "staff": "lead", "tech lead": "lead", "team lead": "lead",
    "engineering manager": "manager", "engineering lead": "lead", "vp": "director",
    "vice president": "director", "head": "director", "c-level": "director",
}
SENIORITY_SPLIT_RE = r"[|/\-,&\s]+"
SKILL_STATUSES = ("matched", "can_add", "partial", "missing")
SKILL_STATUS_ALIASES = {
    "can add": "can_add", "can-add": "can_add", "canadd": "can_add", "highlight": "can_add", "add": "can_add",
    "partially matched": "partial", "partially_matched": "partial", "partial match": "partial",
    "related": "partial", "similar": "partial", "match": "matched", "found": "matched", "not found": "missing",
    "not_found": "missing", "not detected": "missing", "absent": "missing", "unknown": "missing",
}
TRUE_WORDS = ("true", "yes", "1", "clean", "ok", "pass")
FALSE_WORDS = ("false", "no", "0", "dirty", "fail")

# --- keyword forms -----------------------------------------------------------------------------------------------
WORD_ENDINGS = ("s", "es", "d", "ed", "ing", "r", "er", "ment", "tion", "ation", "al", "ly")
STRIPPED_SUFFIXES = ("ation", "tion", "ment", "ing", "ed", "er", "al", "ly", "s")
MIN_WORD_CHARS = 3

# --- scores --------------------------------------------------------------------------------------------------------
SIGNAL_MAX = {
    "keyword_match": 30.0, "section_completeness": 20.0, "format_parsability": 20.0,
    "keyword_placement": 15.0, "date_consistency": 10.0, "file_health": 5.0,
}
NEUTRAL_KEYWORD_MATCH = 15.0
NEUTRAL_KEYWORD_PLACEMENT = 8.0
NEUTRAL_DATES = 5.0
UNREADABLE_FORMAT = 12.0
PLACEMENT_KEYWORDS = 15
PDF_SCAN_BYTES = 500_000
MIN_HEALTHY_CHARS = 100
GARBLED_CLASS = r"[\x{FDE9}-\x{10FFFF}]"
GARBLED_LIMIT = 10
HEADER_WORDS = ("name", "email", "phone")
DATE_MONTH_YEAR_RE = r"(?i)(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{4}"
DATE_MM_YYYY_RE = r"\d{2}/\d{4}"
DATE_YYYY_RE = r"^\s*\d{4}\s*$"

# --- domains -------------------------------------------------------------------------------------------------------
DOMAIN_ABBREVIATIONS = (
    ("hr", "human resources"), ("ai", "artificial intelligence"), ("ml", "machine learning"),
    ("de", "data engineering"), ("da", "data analytics"), ("bi", "business intelligence"),
    ("pm", "project management"), ("ba", "business analyst"), ("qa", "quality assurance"),
    ("sre", "site reliability engineering"), ("ui", "user interface"), ("ux", "user experience"),
    ("it", "information technology"), ("sec", "security"), ("infosec", "information security"),
    ("fintech", "financial technology"), ("bfsi", "banking financial services insurance"),
    ("crm", "customer relationship management"), ("erp", "enterprise resource planning"),
    ("scm", "supply chain management"), ("sap", "sap enterprise"),
)
DOMAIN_STOP_WORDS = ("and", "the", "of", "in", "for", "a", "an", "with", "&", "/")
DOMAIN_CLUSTERS = (
    ("business intelligence", "data analytics", "data analysis", "analytics", "bi", "reporting",
     "data visualisation", "data visualization"),
    ("devops", "cloud", "cloud infrastructure", "platform engineering", "site reliability engineering", "sre",
     "infrastructure"),
    ("healthcare", "medical", "medtech", "health technology", "clinical", "health informatics", "pharma"),
    ("supply chain", "scm", "logistics", "operations management", "procurement", "warehouse"),
    ("human resources", "people operations", "talent management", "hr", "talent acquisition", "recruiting"),
    ("product management", "program management", "project management", "delivery management", "agile"),
    ("marketing", "growth", "digital marketing", "brand management", "content marketing",
     "performance marketing"),
    ("legal", "compliance", "regulatory", "governance", "risk and compliance", "grc"),
    ("finance", "accounting", "financial analysis", "fintech", "investment", "banking", "treasury", "bfsi"),
    ("customer success", "account management", "client management", "customer experience", "cx"),
    ("sales", "business development", "revenue", "pre-sales", "presales"),
    ("education", "edtech", "training", "learning and development", "instructional design"),
)
DOMAIN_NEAR = 0.90
DOMAIN_COMPATIBLE = 0.70
DOMAIN_PARTIAL = 0.40

# --- flags ---------------------------------------------------------------------------------------------------------
FLAG_PRIORITY = {"red": 0, "yellow": 1, "info": 2}
EXPERIENCE_GAP_RED = 5
OVERQUALIFIED_YEARS = 5
SENIORITY_YEARS = 5

# --- text lines ------------------------------------------------------------------------------------------------------
BULLET_CHARS = "•\\-\\*·→⟩▪▸◆◉➢✓✔►"
DOC_BULLET_CHARS = "•\\-\\*·→⟩▪▸◆◉"
SECTION_HEADERS = (
    "PROFESSIONAL SUMMARY", "TECHNICAL SKILLS", "PROFESSIONAL EXPERIENCE", "WORK EXPERIENCE", "EXPERIENCE",
    "EDUCATION", "PROJECTS", "CERTIFICATIONS", "PUBLICATIONS", "PUBLICATIONS & ACHIEVEMENTS", "LANGUAGES",
    "SKILLS", "ACHIEVEMENTS",
)
CATEGORY_LABEL_RE = r"^[A-Za-z0-9 /&]+:\s*\S"
JOB_HEADER_RE = r"^[A-Z][A-Za-z0-9 &.,']+\s*[—–]\s*[A-Z]"
JOB_HEADER_MAX_CHARS = 120
DATE_LINE_RE = r"(?i)^(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|\d{4})\b"
LINE_GAP = 20
ASCII_FORMS = (
    ("•", "-"), ("◦", "-"), ("→", "->"), ("⟩", ">"), ("▪", "-"), ("▸", "-"), ("◆", "-"), ("◉", "-"),
    ("➢", "->"), ("✓", "v"), ("✔", "v"), ("►", "-"), ("–", "-"), ("—", "--"), ("’", "'"),
    ("‘", "'"), ("“", '"'), ("”", '"'), ("…", "..."), ("·", "."),
)
CATEGORY_MIN_CHARS = 20
CATEGORY_LABEL_MAX_CHARS = 50
SENTENCE_VERBS = (
    "repointed", "migrated", "implemented", "developed", "designed", "built", "created", "managed", "led",
    "automated", "optimized", "collaborated", "established", "researched", "performed",
)
SKILL_HINTS = (
    (("langgraph", "langchain", "langsmith", "crewai", "autogen"),
     ("agentic", "orchestration", "langchain", "agent")),
    (("azure ai", "azure openai", "azure ml"), ("cloud", "azure", "deployment", "aws")),
    (("system design", "distributed systems", "architecture"),
     ("agentic", "orchestration", "system", "architecture", "cloud")),
    (("openai", "gpt-4", "chatgpt"), ("llm", "genai", "openai")),
    (("pytorch", "tensorflow", "keras", "sklearn", "scikit"), ("ml", "inference", "pytorch", "tensorflow")),
    (("docker", "kubernetes", "k8s"), ("cloud", "deployment", "docker")),
    (("sql", "postgres", "mysql", "mongodb"), ("data", "storage", "sql", "database")),
)
PREFIX_RATIO = 0.65
LEAD_PREFIX_CHARS = 60
LEAD_PREFIX_SCORE = 0.88
FUZZY_RATIO = 0.75
FUZZY_STOP_RATIO = 0.95
MIN_MATCH_RATE = 0.10

# --- rewriting -------------------------------------------------------------------------------------------------------
BULLET_LENGTH_LOW, BULLET_LENGTH_HIGH = 0.85, 1.15
SUMMARY_LENGTH_LOW, SUMMARY_LENGTH_HIGH = 0.88, 1.12
SUMMARY_MIN_WORDS = 30
SUMMARY_SHORT_WORDS, SUMMARY_DEFAULT_WORDS = 20, 80
SUMMARY_ANCHOR_WORDS = 6
SUMMARY_END_RE = r"\n\s*\n|\n[A-Z][A-Z ]{4,}\n"

# --- caps that are part of a feature ---------------------------------------------------------------------------------
SKILL_UNION_CAP = 30
PLACEHOLDER_CAPS = {"skills": 20, "experience": 10, "bullets": 6, "education": 3, "projects": 5, "certs": 5}
EVIDENCE_CAPS = {"entries": 5, "bullets": 2, "tech": 20, "skills": 30, "required": 20, "technologies": 20}
UPLIFT_STEP, UPLIFT_CAP = 15.0, 98.0
SESSION_TTL_SECONDS = 24 * 60 * 60
SWEEP_SECONDS = 3_600
EXPIRED_MARK_SECONDS = 90 * 24 * 60 * 60
