"""The posting data model: columns, category orders and classification rules."""

from __future__ import annotations

# Headers of the postings CSV -> our column names. Dots stand for
# spaces in files that were written back by a tool that normalises headers.
CSV_COLUMNS = {
    "Job Title": "job_title",
    "Job.Title": "job_title",
    "avg_salary": "avg_salary",
    "min_salary": "min_salary",
    "max_salary": "max_salary",
    "Rating": "rating",
    "age": "age",
    "Sector": "sector",
    "Size": "size",
    "Type of ownership": "ownership",
    "Type.of.ownership": "ownership",
    "job_state": "job_state",
    "same_state": "same_state",
    "python_yn": "python_yn",
    "R_yn": "r_yn",
    "spark": "spark",
    "aws": "aws",
    "excel": "excel",
    "Company Name": "company_name",
    "Company.Name": "company_name",
    "employer_provided": "employer_provided",
    "hourly": "hourly",
}

NUMERIC_COLUMNS = ["avg_salary", "min_salary", "max_salary", "rating", "age"]
TEXT_COLUMNS = ["job_title", "sector", "size", "ownership", "job_state", "company_name"]

# Skill flag column -> displayed skill name, in display order.
SKILLS = {
    "python_yn": "Python",
    "r_yn": "R",
    "spark": "Spark",
    "aws": "AWS",
    "excel": "Excel",
}

FLAG_COLUMNS = ["same_state", *SKILLS, "employer_provided", "hourly"]
OPTIONAL_COLUMNS = ["employer_provided", "hourly"]
RAW_COLUMNS = [*TEXT_COLUMNS, *NUMERIC_COLUMNS, *FLAG_COLUMNS]

# Markers that mean "missing" in text columns.
MISSING_TEXT = {
    "sector": ["-1"],
    "size": ["-1", "Unknown"],
    "ownership": ["-1", "Unknown"],
}

# Columns in which a negative number means "missing".
MISSING_IF_NEGATIVE = ["rating", "age"]

# Fixed values: (label, substrings of the lower-cased title); the first hit wins.
ROLE_RULES = [
    ("Data Scientist", ["data scientist"]),
    ("Data Engineer", ["data engineer"]),
    ("Data Analyst", ["data analyst"]),
    ("ML Engineer", ["machine learning", "ml eng"]),
    ("Director/VP", ["director", "head", "vp", "chief"]),
    ("Manager", ["manager"]),
]
ROLE_DEFAULT = "Other"

SENIORITY_RULES = [
    ("Senior", ["senior", "sr.", "lead", "principal", "staff"]),
    ("Junior", ["junior", "jr.", "associate", "entry"]),
    ("Executive", ["director", "vp", "head", "chief"]),
]
SENIORITY_DEFAULT = "Mid-Level"

# Category orders.
SENIORITY_LEVELS = ["Junior", "Mid-Level", "Senior", "Executive"]
SIZE_LEVELS = [
    "1 to 50 employees",
    "51 to 200 employees",
    "201 to 500 employees",
    "501 to 1000 employees",
    "1001 to 5000 employees",
    "5001 to 10000 employees",
    "10000+ employees",
]
AGE_EDGES = [5, 15, 30, 60]
AGE_LEVELS = [
    "Startup (0-5 yrs)",
    "Young (6-15 yrs)",
    "Established (16-30 yrs)",
    "Mature (31-60 yrs)",
    "Legacy (60+ yrs)",
]
LOCAL, REMOTE = "Same State", "Different State"
LOCALITIES = [LOCAL, REMOTE]
EMPLOYER_CONFIRMED, HOURLY_RATE, ESTIMATED = (
    "Employer Confirmed",
    "Hourly Rate",
    "Glassdoor Estimate",
)

# A posting is kept when its average salary (K USD) is above this value.
MIN_VALID_SALARY = 10
