"""Names, word lists, rules and rates that decide results.

Everything here is data, kept in its natural order because several rule lists
are first-match-wins.
"""

# Source labels as they appear in landed records.
SOURCE_BOARD = "adzuna"
SOURCE_REMOTE = "remotive"
SOURCE_BULK = "kaggle"
REMOTE_ATTRIBUTION = "Remotive (remotive.com)"

# Currency of a posting by ISO country; a missing country counts as US.
COUNTRY_CURRENCY = {
    "US": "USD",
    "GB": "GBP",
    "IN": "INR",
    "CA": "CAD",
    "AU": "AUD",
    "DE": "EUR",
    "FR": "EUR",
    "NL": "EUR",
    "SG": "SGD",
    "NZ": "NZD",
    "ZA": "ZAR",
}

# Names of these countries, in letters only.
COUNTRY_NAMES = {
    "US": ("USA", "UNITEDSTATES", "UNITEDSTATESOFAMERICA", "AMERICA"),
    "GB": ("UK", "UNITEDKINGDOM", "GREATBRITAIN", "ENGLAND", "SCOTLAND", "WALES", "NORTHERNIRELAND"),
    "IN": ("IND", "INDIA"),
    "CA": ("CAN", "CANADA"),
    "AU": ("AUS", "AUSTRALIA"),
    "DE": ("DEU", "GERMANY", "DEUTSCHLAND"),
    "FR": ("FRA", "FRANCE"),
    "NL": ("NLD", "NETHERLANDS", "THENETHERLANDS", "HOLLAND"),
    "SG": ("SGP", "SINGAPORE"),
    "NZ": ("NZL", "NEWZEALAND"),
    "ZA": ("ZAF", "SOUTHAFRICA"),
}

# Units of currency per US dollar, used when no rate table is given.
DEFAULT_FX = {
    "USD": 1.0,
    "EUR": 0.92,
    "GBP": 0.79,
    "CAD": 1.36,
    "AUD": 1.51,
    "INR": 83.0,
    "SGD": 1.35,
    "ZAR": 18.0,
    "NZD": 1.64,
    "CHF": 0.90,
}

SKILLS = (
    "python", "sql", "r", "scala", "java", "javascript", "typescript", "go",
    "rust", "c++", "spark", "hadoop", "kafka", "airflow", "prefect", "dbt",
    "pandas", "numpy", "scikit-learn", "tensorflow", "pytorch", "keras",
    "aws", "gcp", "azure", "docker", "kubernetes", "terraform", "fastapi",
    "flask", "django", "react", "vue", "postgres", "mysql", "mongodb",
    "redis", "elasticsearch", "tableau", "powerbi", "looker", "snowflake",
    "databricks", "bigquery", "redshift", "dask", "pyspark", "mlflow",
    "git", "linux", "bash", "excel", "power bi", "data engineering",
    "machine learning", "deep learning", "nlp", "llm",
)

# Title + category keywords -> canonical title. First match wins.
TITLE_RULES = (
    ("Data Engineer", ("data engineer", "data pipeline", "etl", "data platform")),
    ("Data Scientist", ("data scientist", "data science")),
    ("Data Analyst", ("data analyst", "business analyst", "bi analyst")),
    ("Analytics Engineer", ("analytics engineer",)),
    ("ML Engineer", ("machine learning", "ml engineer", "mlops")),
    ("AI Engineer", ("ai engineer", "nlp engineer", "computer vision")),
    ("Software Engineer", ("backend", "back-end", "software engineer", "software developer")),
    ("Frontend Engineer", ("frontend", "front-end", "react", "ui engineer")),
    ("Full Stack Engineer", ("full stack", "fullstack")),
    ("DevOps/Platform", ("devops", "platform engineer", "sre", "site reliability")),
    ("Cloud Engineer", ("cloud engineer", "cloud architect")),
    ("Security Engineer", ("security engineer", "cybersecurity")),
    ("DBA", ("database admin", "dba")),
    ("Product Manager", ("product manager", "product owner")),
)

# Title keywords -> role family of the wide table. First match wins.
ROLE_RULES = (
    ("Data Engineer", ("data engineer", "etl", "pipeline")),
    ("Data Scientist", ("data scientist",)),
    ("Data Analyst", ("data analyst", "business analyst", "bi analyst")),
    ("ML Engineer", ("ml engineer", "machine learning", "mlops")),
    ("AI Engineer", ("ai engineer", "nlp", "computer vision")),
    ("Software Engineer", ("software engineer", "software developer", "backend", "full stack")),
    ("Frontend Engineer", ("frontend", "front-end", "react")),
    ("DevOps/Platform", ("devops", "platform engineer", "sre")),
    ("Product Manager", ("product manager", "product owner")),
)

# Location substrings -> country, Silver path. First match wins.
COUNTRY_HINTS = (
    ("US", ("usa", "united states", "new york", "san francisco", "seattle", "chicago")),
    ("GB", ("uk", "united kingdom", "london", "manchester", "birmingham")),
    ("CA", ("canada", "toronto", "vancouver", "montreal")),
    ("AU", ("australia", "sydney", "melbourne")),
    ("DE", ("germany", "berlin", "munich")),
    ("IN", ("india", "bangalore", "hyderabad", "mumbai")),
    ("FR", ("france", "paris")),
    ("SG", ("singapore",)),
    ("NL", ("netherlands", "amsterdam")),
)

# Location substrings -> country, wide path. First match wins.
COUNTRY_HINTS_WIDE = (
    ("US", ("us", "usa", "united states", "new york", "san francisco", "seattle")),
    ("GB", ("uk", "united kingdom", "london", "manchester")),
    ("IN", ("india", "bangalore", "hyderabad")),
    ("CA", ("canada", "toronto", "vancouver")),
    ("DE", ("germany", "berlin", "munich")),
    ("AU", ("australia", "sydney", "melbourne")),
)

# Work-place words: Silver path (positive words are tried first).
REMOTE_WORDS = ("remote", "work from home", "wfh", "fully remote", "home-based")
ONSITE_WORDS = ("on-site", "onsite", "in-office", "office only", "must be in")

# Work-place patterns: job-board landing path (negative patterns are tried first).
REMOTE_PATTERNS = (
    r"\bremote\b", r"work from home", r"\bwfh\b", r"fully remote",
    r"remote.first", r"distributed team", r"anywhere in the world",
    r"work anywhere", r"home.based", r"telework",
)
ONSITE_PATTERNS = (
    r"on.?site only", r"no remote", r"must be in office", r"office.based",
    r"in.person only",
)

# Work-place words looked for in a job-type column.
JOB_TYPE_REMOTE = ("remote",)
JOB_TYPE_ONSITE = ("on-site", "onsite", "in-person", "hybrid")

# Category substrings that keep a record of the remote board.
TECH_CATEGORY_WORDS = (
    "software", "data", "devops", "sysadmin", "product", "design",
    "finance", "engineer", "developer", "dev", "tech", "cloud",
    "security", "machine learning", "ai", "analytics", "backend",
    "frontend", "fullstack", "full stack", "mobile", "it ",
)

# Accepted spellings of booleans.
TRUE_WIDE = ("1", "true", "t", "yes", "y")
FALSE_WIDE = ("0", "false", "f", "no", "n")
TRUE_BULK = ("true", "1", "yes", "t")
FALSE_BULK = ("false", "0", "no", "f")

# Bulk datasets: key -> (slug, year of the data).
DATASETS = {
    "global_ai_trends_2025": ("bismasajjad/global-ai-job-market-and-salary-trends-2025", 2025),
    "us_software_engineer_jobs": ("mexwell/us-software-engineer-jobs", 2024),
    "global_ai_data_salary": ("mohankrishnathalla/global-ai-and-data-jobs-salary-dataset", 2025),
    "us_tech_2024": ("christopherkverne/100k-us-tech-jobs-winter-2024", 2024),
    "ai_jobs_2025_2026": ("alitaqishah/ai-jobs-market-2025-2026-salaries", 2026),
    "linkedin_data_jobs": ("tianyimasf/linkedin-data-job-titles-and-postings", 2025),
    "ai_data_science_market": ("mueezraja/ai-data-science-job-market", 2025),
    "job_descriptions_2025": ("adityarajsrv/job-descriptions-2025-tech-and-non-tech-roles", 2025),
    "ai_society": ("sarcasmos/ai-society", 2025),
}
DATASETS_WITHOUT_SKILLS = ("ds_salaries",)

# Canonical field -> column names tried in order, bulk CSV -> envelope.
BULK_ALIASES = {
    "title": ("job_title", "title", "position", "role"),
    "company": ("company_name", "company", "employer", "organization"),
    "location": ("job_location", "location", "city", "region"),
    "country": (
        "job_country", "country", "search_location", "search_country",
        "company_location", "employee_residence",
    ),
    "remote": (
        "job_work_from_home", "work_from_home", "remote_friendly", "is_remote", "remote",
    ),
    "posted_at": (
        "job_posted_date", "posted_at", "date_time", "first_seen", "posting_date", "date_posted",
    ),
    "sal_single": (
        "salary_year_avg", "salary_yearly", "salary_avg", "salary_standardized",
        "salary_in_usd", "salary_usd", "annual_salary", "mean_salary", "salary",
    ),
    "sal_min": ("min_salary", "salary_min", "salary_from", "low_salary", "min_amount"),
    "sal_max": ("max_salary", "salary_max", "salary_to", "high_salary", "max_amount"),
    "skills": ("job_skills", "description_tokens", "required_skills", "skills"),
    "description": ("description", "job_description", "cleaned_description", "summary"),
    "job_type": ("job_type", "employment_type", "work_type", "schedule_type"),
    "work_year": ("work_year",),
    "experience_level": ("experience_level",),
    "employment_type": ("employment_type",),
    "company_size": ("company_size",),
    "remote_ratio": ("remote_ratio",),
    "job_link": ("job_link", "job_url", "job_url_direct"),
}
BULK_ID_COLUMNS = ("job_id", "job_link", "job_url")

# Canonical field -> column names tried in order, raw tables -> wide.
RAW_ALIASES = {
    "title": ("title", "job_title", "position", "role"),
    "company": ("company", "company_name", "employer", "organization"),
    "location": ("location", "job_location", "city", "region"),
    "description": ("description", "job_description", "cleaned_description", "summary"),
    "posted_at": ("posted_at", "date_posted", "job_posted_date", "date_time", "first_seen"),
    "salary_min": ("salary_min", "min_amount", "salary_from", "low_salary"),
    "salary_max": ("salary_max", "max_amount", "salary_to", "high_salary"),
    "salary_single": ("salary_in_usd", "salary", "salary_avg", "mean_salary"),
    "country": ("country", "job_country", "company_location", "employee_residence"),
    "source_record_id": ("src_id", "job_id", "job_link", "job_url", "job_url_direct"),
    "remote": ("is_remote", "remote", "remote_friendly"),
    "skills": ("skills", "job_skills", "description_tokens", "required_skills"),
    "employment_type": ("employment_type", "job_type", "work_type", "schedule_type"),
    "currency": ("currency", "salary_currency"),
}
RAW_RESERVED = ("id", "run_id", "ingested_at", "dataset_key", "source_file", "row_number")

# Salary request form: allowed values.
FORM_TITLES = (
    "data scientist", "nlp engineer", "machine learning engineer", "research scientist",
    "software engineer ai", "ai engineer", "computer vision engineer", "data analyst",
    "software engineer", "senior software engineer", "product manager", "software developer",
    "senior data scientist", "project manager", "senior product manager", "devops engineer",
    "software engineer ii", "full stack developer", "senior data analyst",
    "principal software engineer", "senior software developer", "lead software engineer",
    "staff software engineer", "senior devops engineer", "systems engineer", "java developer",
    "network engineer", "automation engineer", "web developer", "embedded software engineer",
    "senior machine learning engineer", "product marketing manager", "cloud engineer",
    "systems administrator", "cybersecurity engineer", "cybersecurity analyst",
    "software development engineer", "technical product manager", "product owner",
    "sr. software engineer", "other",
)
FORM_INDUSTRIES = (
    "Unknown", "Retail", "Gaming", "Education", "Finance", "Energy", "Tech", "Consulting",
    "Automotive", "Telecom", "Healthcare", "Internet And Software",
    "Consulting And Business Services", "Education And Schools", "It-Jobs", "Other",
)
# Industries the model knows: the form's list without Automotive.
MODEL_INDUSTRIES = (
    "Consulting", "Consulting And Business Services", "Education", "Education And Schools",
    "Energy", "Finance", "Gaming", "Healthcare", "Internet And Software", "It-Jobs", "Other",
    "Retail", "Tech", "Telecom", "Unknown",
)
FORM_REMOTE = ("Remote", "On-site")
FORM_SKILLS = (
    "python", "sql", "aws", "azure", "gcp", "java", "scala", "c++", "c#", "javascript",
    "typescript", "react", "node", "angular", "vue", "kubernetes", "docker", "terraform",
    "linux", "git", "ci/cd", "machine learning", "deep learning", "nlp", "computer vision",
    "pandas", "numpy", "spark", "hadoop", "kafka", "snowflake", "tableau", "power bi",
    "looker", "excel", "nosql", "mongodb", "postgresql", "pytorch", "tensorflow",
    "scikit-learn", "airflow", "dbt",
)
FORM_YEARS = (0.0, 30.0)
PREDICTION_BAND = 0.12
