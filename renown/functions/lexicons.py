"""Fixed vocabularies.

FIXED VALUES: every list and mapping in this module must equal the values the
reputation application uses, because results (tags, filters, labels, caps)
depend on them literally.  They are kept verbatim, in their natural order.
Operators receive them as Python lists that become literal arrays or small
broadcast dimension tables; callers may pass their own lists instead.
"""

from __future__ import annotations

# --- FIXED VALUES: geography keywords, as coded (the missing comma after
# "Gampaha" fuses it with the first Sinhala entry; the fused string contains an
# upper-case letter and therefore never matches lowered text) ---
GEO_KEYWORDS = [
    "sri lanka", "srilanka", "colombo", "kandy", "galle", "negombo",
    "jaffna", "matara", "kurunegala", "anuradhapura", "trincomalee",
    "batticaloa", "ratnapura", "badulla", "moratuwa", "dehiwala",
    "maharagama", "kotte", "nugegoda", "rajagiriya", "battaramulla",
    "lkr", "rs.", "rupees", "Gampaha" "ශ්‍රී ලංකා",
    "කොළඹ", "ලංකා", "රු",
    "இலங்கை", "கொழும்பு",
]
GEO_DOMAIN_SUFFIX = ".lk"

# --- FIXED VALUES: regulatory bodies, in order ---
REGULATORY_BODIES = [
    "cbsl", "central bank of sri lanka",
    "sec", "securities and exchange commission",
    "consumer affairs authority", "caa",
    "board of investment", "boi",
    "inland revenue", "ird",
]

# --- FIXED VALUES: crisis categories and their patterns, in order ---
CRISIS_PATTERNS = [
    ("Mass layoffs or retrenchment", [
        "layoff", "lay off", "retrenchment", "mass firing",
        "downsizing", "workforce reduction", "let go",
    ]),
    ("Legal case or court proceeding", [
        "court case", "lawsuit", "legal action", "sued",
        "tribunal", "litigation", "court order",
    ]),
    ("Financial distress", [
        "unpaid salaries", "salary delay", "salary not paid",
        "financial trouble", "bankruptcy", "liquidation",
        "debt default", "insolvent",
    ]),
    ("Product safety complaints", [
        "product recall", "safety hazard", "dangerous product",
        "health risk", "contamination",
    ]),
    ("Regulatory action", [
        "cbsl action", "sec investigation", "regulatory penalty",
        "fined by", "license revoked", "compliance violation",
    ]),
]
REGULATORY_FLAG_PREFIX = "Regulatory body mentioned: "

# --- FIXED VALUES: news sites, in order ---
NEWS_SITES = [
    "dailymirror.lk",
    "sundaytimes.lk",
    "lankabusinessonline.com",
    "adaderana.lk",
    "colombogazette.com",
    "ft.lk",
    "island.lk",
    "newsfirst.lk",
    "economynext.com",
]

# --- FIXED VALUES: applicant-tracking domains and careers-link phrases ---
ATS_DOMAINS = [
    "workday", "myworkdaysite.com", "greenhouse.io", "lever.co",
    "smartrecruiters", "bamboohr", "taleo", "icims", "ashbyhq", "workable",
]
CAREERS_LINK_PHRASES = ["explore", "view jobs", "openings", "search jobs"]

# --- FIXED VALUES: ignore phrases of the two job-card layouts ---
JOB_CARD_IGNORE_B = ["we did not find any result", "back to ikman", "no ads found", "0 ads"]
JOB_CARD_IGNORE_C = ["no vacancies found", "0 results"]

# --- FIXED VALUES: platforms in crawl order (order decides first-seen) ---
PLATFORMS = [
    "reddit", "google_maps", "glassdoor", "topjobs",
    "linkedin", "facebook", "news", "web",
]

# --- FIXED VALUES: per-platform result caps ---
PLATFORM_CAPS = {
    "reddit": 30, "google_maps": 20, "glassdoor": 40, "topjobs": 30,
    "linkedin": 10, "facebook": 15, "news": 20, "web": 10,
}

# --- FIXED VALUES: report section key and display name per platform ---
SECTION_KEYS = {
    "reddit": "reddit", "google_maps": "google_maps", "glassdoor": "glassdoor",
    "topjobs": "topjobs_ikman", "linkedin": "linkedin", "facebook": "facebook",
    "news": "sl_news", "web": "web_general",
}
SECTION_NAMES = {
    "reddit": "Reddit", "google_maps": "Google Maps",
    "glassdoor": "Glassdoor / Indeed", "topjobs": "Job Boards & Official Careers",
    "linkedin": "LinkedIn", "facebook": "Facebook", "news": "SL News",
    "web": "General Web",
}

# --- FIXED VALUES: classification enumerations ---
SENTIMENTS = ["positive", "negative", "neutral"]
REVIEWER_TYPES = ["employee", "customer", "job_seeker", "press", "general"]
THEMES = [
    "salary_benefits", "work_life_balance", "management_culture",
    "product_quality", "customer_service", "pricing", "delivery",
    "job_security", "office_environment", "career_growth",
    "ethical_practices", "layoffs_restructuring",
]
SEVERITIES = ["low", "medium", "high", "critical"]
LANGUAGES = ["en", "si", "ta", "mixed"]

# --- FIXED VALUES: display labels ---
REVIEWER_BADGES = {
    "employee": "👤 Employee",
    "customer": "🛒 Customer",
    "press": "📰 Press",
    "job_seeker": "💼 Job Seeker",
    "general": "🌐 General",
}
THEME_LABELS = {
    "salary_benefits": "💰 Salary & Benefits",
    "work_life_balance": "⚖️ Work-Life Balance",
    "management_culture": "🏢 Management Culture",
    "product_quality": "⭐ Product Quality",
    "customer_service": "🎧 Customer Service",
    "pricing": "🏷️ Pricing",
    "delivery": "📦 Delivery",
    "job_security": "🛡️ Job Security",
    "office_environment": "🏠 Office Environment",
    "career_growth": "📈 Career Growth",
    "ethical_practices": "🤝 Ethical Practices",
    "layoffs_restructuring": "⚠️ Layoffs/Restructuring",
}

# --- FIXED VALUES: sort ranks of the ranked views (unknown gets the default) ---
RANK_MOST_NEGATIVE = ({"negative": 0, "neutral": 1, "positive": 2}, 1)
RANK_MOST_POSITIVE = ({"positive": 0, "neutral": 1, "negative": 2}, 1)
RANK_SEVERITY = ({"critical": 0, "high": 1, "medium": 2, "low": 3}, 3)

# --- FIXED VALUES: classifier failure defaults ---
CLASSIFY_DEFAULTS = {
    "sentiment": "neutral", "confidence": 0.0, "reviewer_type": "general",
    "themes": [], "severity": "low", "language_detected": "en",
}

# --- FIXED VALUES: summary defaults (parse failure, and summary-step failure) ---
SUMMARY_PARSE_DEFAULTS = {
    "what_employees_say": "Analysis could not be completed.",
    "what_customers_say": "Analysis could not be completed.",
    "what_press_says": "Analysis could not be completed.",
    "recommendation": "Insufficient data for recommendation.",
    "overall_score": 50,
}
SUMMARY_FAILED_DEFAULTS = {
    "what_employees_say": "Summary generation failed.",
    "what_customers_say": "Summary generation failed.",
    "what_press_says": "Summary generation failed.",
    "recommendation": "Unable to generate recommendation.",
    "overall_score": 50,
}
# defaults used by the report when the summary lacks a key
REPORT_SUMMARY_DEFAULTS = {
    "what_employees_say": "No employee data available.",
    "what_customers_say": "No customer data available.",
    "what_press_says": "No press data available.",
    "recommendation": "Insufficient data.",
}

# --- FIXED VALUES: prompt texts ---
CLASSIFY_USER_PREFIX = "Classify this text:\n\n"
CLASSIFY_TEXT_CHARS = 2000
SUMMARY_ROWS = 100
SUMMARY_TEXT_CHARS = 200

# --- FIXED VALUES: Latin-1 export replacements, in order ---
LATIN1_REPLACEMENTS = [
    ("—", "-"),
    ("–", "-"),
    ("‘", "'"),
    ("’", "'"),
    ("“", '"'),
    ("”", '"'),
    ("…", "..."),
    ("\u200b", ""),
]

# --- FIXED VALUES: CSV export header ---
CSV_HEADER = [
    "Source Platform", "Source URL", "Sentiment", "Confidence", "Reviewer Type",
    "Themes", "Severity", "Language", "Date", "Raw Text (truncated)",
]

# --- FIXED VALUES: company aliases (alias -> full name), in file order ---
COMPANY_ALIASES = [
    ("JKH", "John Keells Holdings"),
    ("LOLC", "Lanka ORIX Leasing Company"),
    ("SLT", "Sri Lanka Telecom"),
    ("Dialog", "Dialog Axiata"),
    ("Mobitel", "Sri Lanka Telecom Mobitel"),
    ("HNB", "Hatton National Bank"),
    ("ComBank", "Commercial Bank of Ceylon"),
    ("Sampath", "Sampath Bank"),
    ("NDB", "National Development Bank"),
    ("DFCC", "DFCC Bank"),
    ("CDB", "Citizens Development Business Finance"),
    ("Brandix", "Brandix Lanka"),
    ("MAS", "MAS Holdings"),
    ("Virtusa SL", "Virtusa Sri Lanka"),
    ("IFS SL", "IFS Sri Lanka"),
    ("99x", "99x Technology"),
    ("ADL", "Axiata Digital Labs"),
    ("Sysco", "Sysco LABS Sri Lanka"),
    ("MIT", "Millennium IT"),
    ("LSEG SL", "LSEG Sri Lanka"),
    ("PickMe", "PickMe"),
    ("Uber SL", "Uber Sri Lanka"),
    ("Daraz SL", "Daraz Sri Lanka"),
    ("Unilever SL", "Unilever Sri Lanka"),
    ("Nestle SL", "Nestle Sri Lanka"),
    ("CEB", "Ceylon Electricity Board"),
    ("BOC", "Bank of Ceylon"),
    ("Peoples", "People's Bank Sri Lanka"),
    ("NSB", "National Savings Bank"),
    ("SriLankan", "SriLankan Airlines"),
    ("Cinnamon", "Cinnamon Hotels & Resorts"),
    ("Aitken Spence", "Aitken Spence PLC"),
    ("Hayleys", "Hayleys PLC"),
    ("Richard Pieris", "Richard Pieris & Company"),
    ("DSI", "DSI Samson Group"),
]

# --- FIXED VALUES: search-query template per platform ({c} = company) ---
QUERY_TEMPLATES = {
    "reddit": "{c} Sri Lanka",
    "google_maps": "{c} Sri Lanka",
    "glassdoor": "{c}",
    "indeed": "{c}",
    "topjobs": "{c}",
    "ikman": "{c}",
    "jobsnet": "{c}",
    "linkedin": "{c}",
    "facebook": "{c} Sri Lanka",
    "news": '"{c}" site:.lk',
    "web": '"{c}" "Sri Lanka" review OR complaint OR feedback',
}
QUERY_TEMPLATE_DEFAULT = '{c} site:.lk OR "Sri Lanka" OR "Colombo"'

# --- FIXED VALUES: thresholds ---
SNAPSHOT_TTL_SECONDS = 48 * 3600
NEAR_DUP_THRESHOLD = 0.85
FINGERPRINT_CHARS = 200
SAFE_TEXT_CHARS = 5000
MAX_POST_AGE_DAYS = 2 * 365
FORUM_SOFT_CAP = 30
FORUM_COMMENTS_PER_POST = 5
