"""Cleaning rules on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from paylens import model as m
from paylens.functions.columns import first_match, to_number
from paylens.operators import cleaning
from paylens.sources.postings_csv import read_postings_csv
from paylens.sources.skills import skill_dictionary, with_skill_name

DEFAULTS = {c: None for c in m.RAW_COLUMNS} | {"avg_salary": "100", "min_salary": "80", "max_salary": "120"}


def clean(spark, rows):
    schema = ", ".join(f"{c} string" for c in m.RAW_COLUMNS)
    data = [tuple((DEFAULTS | row)[c] for c in m.RAW_COLUMNS) for row in rows]
    return cleaning.clean(spark.createDataFrame(data, schema))


def column(spark, name, given, col):
    rows = clean(spark, [{name: value, "company_name": f"{i:03}"} for i, value in enumerate(given)])
    return [r[0] for r in rows.orderBy("company_name").select(col).collect()]


TITLES = {
    "Senior Data Scientist Manager": ("Data Scientist", "Senior"),
    "Associate Director, Data": ("Director/VP", "Junior"),
    "Lead Director": ("Director/VP", "Senior"),
    "Sr Data Analyst": ("Data Analyst", "Mid-Level"),
    "Sr. Data Analyst": ("Data Analyst", "Senior"),
    "Leadership Coach": ("Other", "Senior"),
    "Ahead Analyst": ("Director/VP", "Executive"),
    "ML Eng II": ("ML Engineer", "Mid-Level"),
    "MACHINE LEARNING Intern": ("ML Engineer", "Mid-Level"),
    "Data Engineer, Data Analyst": ("Data Engineer", "Mid-Level"),
    "Chief Manager": ("Director/VP", "Executive"),
    "Manager": ("Manager", "Mid-Level"),
    "": ("Other", "Mid-Level"),
    None: ("Other", "Mid-Level"),
}


def test_titles(spark):
    assert column(spark, "job_title", TITLES, "role") == [role for role, _ in TITLES.values()]
    assert column(spark, "job_title", TITLES, "seniority") == [level for _, level in TITLES.values()]
    levels = {name: i for i, name in enumerate(m.SENIORITY_LEVELS, 1)}
    assert column(spark, "job_title", TITLES, "seniority_rank") == [levels[level] for _, level in TITLES.values()]


def test_missing_markers(spark):
    assert column(spark, "rating", ["-1", "0", "4.5", "abc", None, "NaN"], "rating") == [None, 0.0, 4.5, None, None, None]
    assert column(spark, "sector", ["-1", "Unknown", "Media", ""], "sector") == [None, "Unknown", "Media", ""]
    assert column(spark, "ownership", ["-1", "Unknown", "Public"], "ownership") == [None, None, "Public"]


def test_numbers(spark):
    given = [" 11 ", "1e1", "12f", "12d", "$5", "-3", ""]
    assert column(spark, "min_salary", given, "min_salary") == [11.0, 10.0, None, None, None, -3.0, None]


def test_age_bands(spark):
    ages = ["-1", "0", "5", "6", "15", "16", "30", "31", "60", "61", "5.5"]
    names = [m.AGE_LEVELS[i] for i in (0, 0, 1, 1, 2, 2, 3, 3, 4, 1)]
    assert column(spark, "age", ages, "age_group") == [None, *names]
    assert column(spark, "age", ages, "age_rank") == [None, 1, 1, 2, 2, 3, 3, 4, 4, 5, 2]


def test_sizes(spark):
    sizes = ["Unknown", "-1", "5 employees", "10000+ employees", "1 to 50 employees", None]
    assert column(spark, "size", sizes, "size_rank") == [None, None, None, 7, 1, None]
    assert column(spark, "size", sizes, "size") == [None, None, None, "10000+ employees", "1 to 50 employees", None]


def test_state_is_trimmed_of_all_white_space(spark):
    assert column(spark, "job_state", ["\tCA ", " NY \n", "New York"], "job_state") == ["CA", "NY", "New York"]


def test_validity(spark):
    given = ["10", "10.01", None, "n/a"]
    kept = clean(spark, [{"avg_salary": v} for v in given]).select("avg_salary").collect()
    assert [r[0] for r in kept] == [10.01]


def test_locality_and_source(spark):
    assert column(spark, "same_state", ["1", "0", None, "1.0"], "locality") == [m.LOCAL, m.REMOTE, None, m.LOCAL]
    rows = clean(
        spark,
        [
            {"employer_provided": "1", "hourly": "1", "company_name": "a"},
            {"employer_provided": "0", "hourly": "1", "company_name": "b"},
            {"employer_provided": "0", "hourly": "0", "company_name": "c"},
            {"company_name": "d"},
        ],
    )
    found = [r[0] for r in rows.orderBy("company_name").select("sal_source").collect()]
    assert found == [m.EMPLOYER_CONFIRMED, m.HOURLY_RATE, m.ESTIMATED, m.ESTIMATED]


def test_spread(spark):
    assert column(spark, "max_salary", ["120", "x"], "sal_spread") == [40.0, None]


def test_single_step_operators(spark):
    df = spark.createDataFrame([("Head of ML",), ("Clerk",)], "t string")
    out = cleaning.classify(df, "t", [("Boss", ["head"])], "None", "label")
    assert [tuple(r) for r in out.collect()] == [("Head of ML", "Boss"), ("Clerk", "None")]
    df = spark.createDataFrame([(1.0,), (2.0,), (2.5,), (None,)], "x double")
    assert [r["b"] for r in cleaning.band(df, "x", [1, 2], ["low", "mid", "high"], "b").collect()] == [
        "low",
        "mid",
        "high",
        None,
    ]


CSV = '''"",Job Title,avg_salary,min_salary,max_salary,Rating,age,Sector,Size,Type of ownership,job_state,same_state,python_yn,R_yn,spark,aws,excel,Company Name,employer_provided,hourly,extra
0,"Data
Scientist ""A""",72.0,53,91,3.8,47,Media,Unknown,Public, NM,0,1,0,0,0,1,"Acme, Inc",0,0,x
1,Data Engineer,NA,53,91,3.8,47,Media,Unknown,Public,CA,0,1,0,0,0,1,B,0,0,x
2,Data Engineer, 11 ,bad,91,-1,-1,-1,1 to 50 employees,"",CA,1,0,0,1,0,1,C,1,0,x
3,Data Analyst,50,40,60,4,5,,,Private,TX,NA,0,0,0,0,0,,0,1,x
'''


@pytest.mark.parametrize("dotted", [False, True])
def test_csv(spark, tmp_path, dotted):
    header, rest = CSV.split("\n", 1)
    path = tmp_path / "postings.csv"
    path.write_text((header.replace(" ", ".") if dotted else header) + "\n" + rest)
    raw = read_postings_csv(spark, str(path))
    assert set(raw.columns) == set(m.RAW_COLUMNS)
    rows = cleaning.clean(raw).orderBy(F.desc("avg_salary")).collect()
    assert [r["avg_salary"] for r in rows] == [72.0, 50.0, 11.0]
    a, d, c = rows
    assert a["job_title"] == 'Data\nScientist "A"'
    assert (a["company_name"], a["size"], a["job_state"], a["python_yn"]) == ("Acme, Inc", None, "NM", 1)
    assert (c["min_salary"], c["rating"], c["age"], c["sector"], c["ownership"]) == (None, None, None, None, "")
    assert (c["locality"], c["sal_source"], c["sal_spread"]) == (m.LOCAL, m.EMPLOYER_CONFIRMED, None)
    assert (d["sector"], d["size"], d["locality"], d["age_group"]) == (None, None, None, m.AGE_LEVELS[0])


def test_csv_without_a_needed_column(spark, tmp_path):
    path = tmp_path / "postings.csv"
    path.write_text("Job Title,avg_salary\nx,1\n")
    with pytest.raises(ValueError, match="columns not found"):
        read_postings_csv(spark, str(path))


def test_skill_dictionary(spark):
    assert [tuple(r) for r in skill_dictionary(spark).orderBy("skill_pos").collect()] == [
        ("python_yn", "Python", 1),
        ("r_yn", "R", 2),
        ("spark", "Spark", 3),
        ("aws", "AWS", 4),
        ("excel", "Excel", 5),
    ]
    df = spark.createDataFrame([("aws",), ("nothing",)], "col string")
    assert [r["skill"] for r in with_skill_name(df).collect()] == ["AWS"]


@pytest.mark.parametrize("text", ["1e10", "inf", "Infinity", "NaN", "1.9", "0.5", "x", ""])
def test_flags_that_are_no_whole_number(spark, text):
    df = spark.createDataFrame([(text, "1.0")], "a string, b string")
    assert df.select(to_number("a", True, "int"), to_number("b", True, "int")).first() == (None, 1)


@pytest.mark.parametrize("text", ["1e400", "-inf", "Infinity", "NaN"])
def test_amounts_are_finite(spark, text):
    assert spark.createDataFrame([(text,)], "a string").select(to_number("a", True)).first()[0] is None
    assert spark.createDataFrame([(float(text),)], "a double").select(to_number("a", False)).first()[0] is None


def test_rules_may_be_patterns(spark):
    rules = [("nlp", "^ml |nlp"), ("dotted", r"sr\."), ("plain", ["b", "c"])]
    given = {"ml ops": "nlp", "old ml": "-", "an nlp": "nlp", "sr. x": "dotted", "sr x": "-", "abe": "plain"}
    df = spark.createDataFrame([(t,) for t in given], "t string")
    assert [r[0] for r in df.select(first_match("t", rules, "-")).collect()] == list(given.values())


def test_csv_files_of_differing_headers_are_joined_by_name(spark, tmp_path):
    header = [c for c in m.CSV_COLUMNS if "." not in c]
    files = {
        "a": header,
        "b": header[::-1],
        "c": [c.replace(" ", ".") for c in header[3:] + header[:3]] + ["", "More"],
        "d": [c for c in header if c not in ("hourly", "excel", "Sector")],
        "e": header,
    }
    for name, cols in files.items():
        row = [f"{name}:{c.replace('.', ' ')}" for c in cols]
        (tmp_path / f"{name}.csv").write_text(",".join(cols) + "\n" + ",".join(row) + "\n")
    (tmp_path / "empty.csv").write_text("")
    df = read_postings_csv(spark, str(tmp_path))
    named = {m.CSV_COLUMNS[c]: c for c in header}
    want = {name: {ours: f"{name}:{c}" if name != "d" or c in files["d"] else None for ours, c in named.items()} for name in files}
    got = {r["job_title"][0]: r.asDict() for r in df.collect()}
    assert got == want and set(df.columns) == set(m.RAW_COLUMNS)
    # Files of one header are one scan, and each file is in one of them.
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan csv") == 4
    assert len(read_postings_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]).collect()) == 2


def test_csv_without_salary_sources(spark, tmp_path):
    header = [c for c in m.CSV_COLUMNS if "." not in c and c not in ("employer_provided", "hourly")]
    (tmp_path / "a.csv").write_text(",".join(header) + "\n" + ",".join("50" for _ in header) + "\n")
    df = cleaning.clean(read_postings_csv(spark, str(tmp_path)))
    assert [r["sal_source"] for r in df.collect()] == [m.ESTIMATED]
