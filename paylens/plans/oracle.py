"""Independent SQL for every registered query, to be run by DuckDB."""

from __future__ import annotations

# Fixed values in the SQL below: rule words, markers, labels, category orders and limits of the data model. They are
# written out again, not imported, so that the SQL does not depend on the code that it checks.

RAW = """
raw AS (
  SELECT
    concat(
      CASE o_orderpriority WHEN '1-URGENT' THEN 'Senior ' WHEN '2-HIGH' THEN 'Lead '
        WHEN '3-MEDIUM' THEN '' WHEN '4-NOT SPECIFIED' THEN 'Jr. ' ELSE 'Associate ' END,
      CASE p_size % 8 WHEN 0 THEN 'Data Scientist' WHEN 1 THEN 'Data Engineer' WHEN 2 THEN 'Data Analyst'
        WHEN 3 THEN 'Machine Learning Engineer' WHEN 4 THEN 'Director of Analytics'
        WHEN 5 THEN 'Analytics Manager' WHEN 6 THEN 'Statistician' ELSE 'VP, Data Science' END) AS job_title,
    l_extendedprice/400*(1-l_discount) AS min_salary,
    l_extendedprice/400*(1+l_tax+cast(0.05 as double)) AS max_salary,
    (l_extendedprice/400*(1-l_discount) + l_extendedprice/400*(1+l_tax+cast(0.05 as double)))/2 AS avg_salary,
    CASE WHEN l_linenumber=7 THEN cast(-1 as double) ELSE 1+cast(l_partkey%41 as double)/10 END AS rating,
    cast(CASE WHEN l_linenumber=6 THEN -1 ELSE (l_partkey*7)%121 END as double) AS age,
    CASE WHEN p_brand='Brand#1' THEN '-1' ELSE p_brand END AS sector,
    CASE l_suppkey % 9 WHEN 0 THEN '1 to 50 employees' WHEN 1 THEN '51 to 200 employees'
      WHEN 2 THEN '201 to 500 employees' WHEN 3 THEN '501 to 1000 employees'
      WHEN 4 THEN '1001 to 5000 employees' WHEN 5 THEN '5001 to 10000 employees'
      WHEN 6 THEN '10000+ employees' WHEN 7 THEN 'Unknown' ELSE '-1' END AS size,
    CASE WHEN c_custkey%7=0 THEN '-1' WHEN c_custkey%7=1 THEN 'Unknown' ELSE c_mktsegment END AS ownership,
    concat(' ', n_name, ' ') AS job_state,
    cast(s_nationkey = c_nationkey as integer) AS same_state,
    cast(l_quantity >= 25 as integer) AS python_yn,
    cast(l_quantity % 20 = 0 as integer) AS r_yn,
    cast(p_size % 4 = 0 as integer) AS spark,
    cast(l_linenumber <= 2 as integer) AS aws,
    cast(l_discount >= cast(0.05 as double) as integer) AS excel,
    cast(l_returnflag = 'A' as integer) AS employer_provided,
    cast(l_linestatus = 'F' as integer) AS hourly,
    s_name AS company_name
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
)"""

CLEANED = """
nulled AS (
  SELECT job_title, company_name, min_salary, max_salary, avg_salary,
    same_state, python_yn, r_yn, spark, aws, excel, employer_provided, hourly,
    regexp_replace(job_state, '^\\s+|\\s+$', '', 'g') AS job_state,
    CASE WHEN rating < 0 THEN NULL ELSE rating END AS rating,
    CASE WHEN age < 0 THEN NULL ELSE age END AS age,
    nullif(sector, '-1') AS sector,
    CASE WHEN size IN ('-1', 'Unknown') THEN NULL ELSE size END AS size,
    CASE WHEN ownership IN ('-1', 'Unknown') THEN NULL ELSE ownership END AS ownership
  FROM raw
  WHERE avg_salary > 10
), d AS (
  SELECT *, max_salary - min_salary AS sal_spread,
    CASE WHEN regexp_matches(lower(job_title), 'data scientist') THEN 'Data Scientist'
      WHEN regexp_matches(lower(job_title), 'data engineer') THEN 'Data Engineer'
      WHEN regexp_matches(lower(job_title), 'data analyst') THEN 'Data Analyst'
      WHEN regexp_matches(lower(job_title), 'machine learning|ml eng') THEN 'ML Engineer'
      WHEN regexp_matches(lower(job_title), 'director|head|vp|chief') THEN 'Director/VP'
      WHEN regexp_matches(lower(job_title), 'manager') THEN 'Manager'
      ELSE 'Other' END AS role,
    CASE WHEN regexp_matches(lower(job_title), 'senior|sr[.]|lead|principal|staff') THEN 'Senior'
      WHEN regexp_matches(lower(job_title), 'junior|jr[.]|associate|entry') THEN 'Junior'
      WHEN regexp_matches(lower(job_title), 'director|vp|head|chief') THEN 'Executive'
      ELSE 'Mid-Level' END AS seniority,
    CASE seniority WHEN 'Junior' THEN 1 WHEN 'Mid-Level' THEN 2 WHEN 'Senior' THEN 3 ELSE 4 END AS seniority_rank,
    CASE size WHEN '1 to 50 employees' THEN 1 WHEN '51 to 200 employees' THEN 2
      WHEN '201 to 500 employees' THEN 3 WHEN '501 to 1000 employees' THEN 4
      WHEN '1001 to 5000 employees' THEN 5 WHEN '5001 to 10000 employees' THEN 6
      WHEN '10000+ employees' THEN 7 END AS size_rank,
    CASE WHEN age IS NULL THEN NULL WHEN age <= 5 THEN 1 WHEN age <= 15 THEN 2 WHEN age <= 30 THEN 3
      WHEN age <= 60 THEN 4 ELSE 5 END AS age_rank,
    CASE age_rank WHEN 1 THEN 'Startup (0-5 yrs)' WHEN 2 THEN 'Young (6-15 yrs)'
      WHEN 3 THEN 'Established (16-30 yrs)' WHEN 4 THEN 'Mature (31-60 yrs)'
      WHEN 5 THEN 'Legacy (60+ yrs)' END AS age_group,
    CASE same_state WHEN 1 THEN 'Same State' WHEN 0 THEN 'Different State' END AS locality,
    CASE WHEN employer_provided = 1 THEN 'Employer Confirmed' WHEN hourly = 1 THEN 'Hourly Rate'
      ELSE 'Glassdoor Estimate' END AS sal_source
  FROM nulled
)"""

GLOBAL = "g AS (SELECT * FROM d WHERE avg_salary BETWEEN 10 AND 260)"
GLOBAL_SENIOR = "g AS (SELECT * FROM d WHERE avg_salary BETWEEN 10 AND 260 AND seniority = 'Senior')"
GLOBAL_NARROW = """g AS (SELECT * FROM d WHERE avg_salary BETWEEN 80 AND 120
  AND role = 'Data Engineer' AND sector = 'Brand#7' AND seniority = 'Junior')"""
GLOBAL_OPEN = "g AS (SELECT * FROM d WHERE avg_salary >= 10)"
GLOBAL_NONE = "g AS (SELECT * FROM d WHERE avg_salary BETWEEN 10 AND 260 AND sector = 'none')"
PROFILE = "p AS (SELECT * FROM d WHERE role = 'Data Scientist' AND python_yn = 1)"
PROFILE_ANY = "p AS (SELECT * FROM d)"
PROFILE_FULL = """p AS (SELECT * FROM d WHERE role = 'ML Engineer' AND job_state = 'NATION_3'
  AND seniority = 'Senior' AND python_yn = 1 AND excel = 1)"""

SKILL_LIST = [("python_yn", "Python"), ("r_yn", "R"), ("spark", "Spark"), ("aws", "AWS"), ("excel", "Excel")]

RANGES = """ranges AS (
  SELECT role, round(median(min_salary), 6) AS lo, round(median(avg_salary), 6) AS mid,
    round(median(max_salary), 6) AS hi, count(*) AS n
  FROM g GROUP BY role)"""
RANGE_BY_ROLE = "SELECT *, row_number() OVER (ORDER BY mid, role) AS pos FROM ranges"

STATE_MEDIANS = """states AS (
  SELECT job_state, round(median(avg_salary), 6) AS median, count(*) AS n
  FROM g GROUP BY job_state HAVING count(*) >= 3)"""
STATE_COUNTS = "states AS (SELECT job_state, count(*) AS n FROM g GROUP BY job_state)"

TOP_STATES = """SELECT job_state, median, n, median = max(median) OVER () AS is_top,
  row_number() OVER (ORDER BY median, job_state) AS pos
  FROM (SELECT *, rank() OVER (ORDER BY median DESC) AS r FROM states) WHERE r <= 15"""
BUSY_STATES = """SELECT job_state, n, n = max(n) OVER () AS is_top,
  row_number() OVER (ORDER BY n, job_state) AS pos
  FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS r FROM states) WHERE r <= 15"""

STATS = "stats AS (" + " UNION ALL ".join(
    f"""SELECT '{name}' AS skill, {i} AS skill_pos, count(*) AS n,
    round(avg({flag}) * 100, 6) AS demand,
    round(avg(avg_salary) FILTER (WHERE {flag} = 1) - avg(avg_salary) FILTER (WHERE {flag} = 0), 6) AS premium
    FROM g"""
    for i, (flag, name) in enumerate(SKILL_LIST, 1)
) + ")"

PAIRS = "pairs AS (" + " UNION ALL ".join(
    f"""SELECT '{na}' AS skill_a, '{nb}' AS skill_b, count(*) AS n,
    round_even(avg(cast({a} = 1 AND {b} = 1 AS integer)) * 100, 0) AS pct FROM g"""
    for a, na in SKILL_LIST
    for b, nb in SKILL_LIST
) + ")"


def _box(key: str, labels: str) -> str:
    return f"""
  , q AS (
    SELECT {key}, count(*) AS n, quantile_cont(avg_salary, 0.25) AS q1,
      quantile_cont(avg_salary, 0.5) AS median, quantile_cont(avg_salary, 0.75) AS q3
    FROM g WHERE {key} IN ({labels}) GROUP BY {key}),
  w AS (
    SELECT g.{key},
      min(avg_salary) FILTER (WHERE avg_salary BETWEEN q1-1.5*(q3-q1) AND q3+1.5*(q3-q1)) AS lo,
      max(avg_salary) FILTER (WHERE avg_salary BETWEEN q1-1.5*(q3-q1) AND q3+1.5*(q3-q1)) AS hi,
      count(*) FILTER (WHERE avg_salary < q1-1.5*(q3-q1) OR avg_salary > q3+1.5*(q3-q1)) AS n_outliers
    FROM g JOIN q ON g.{key} = q.{key} GROUP BY g.{key})
  SELECT q.{key}, n, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
    round(least(q1, lo), 6) AS whisker_lo, round(greatest(q3, hi), 6) AS whisker_hi, n_outliers
  FROM q JOIN w ON q.{key} = w.{key}"""


def _level(col: str, rank: str, source: str) -> str:
    return f"""
  , m AS (SELECT {col}, {rank}, round(median(avg_salary), 6) AS median, count(*) AS n
    FROM {source} WHERE {col} IS NOT NULL GROUP BY {col}, {rank})
  SELECT {col}, cast({rank} AS bigint) AS {rank}, median, n, median = max(median) OVER () AS is_peak FROM m"""


DOMAINS = "\n  UNION ALL ".join(
    [
        f"""SELECT '{domain}' AS domain, {col} AS value, row_number() OVER (ORDER BY {col}) AS pos
    FROM (SELECT DISTINCT {col} FROM d WHERE {col} IS NOT NULL)
  UNION ALL SELECT '{domain}', '{front}', 0"""
        for domain, col, front in [
            ("role", "role", "All"),
            ("sector", "sector", "All"),
            ("ownership", "ownership", "All"),
            ("state", "job_state", "Any"),
            ("profile_role", "role", "Any"),
        ]
    ]
    + [
        """SELECT * FROM (VALUES
    ('seniority', 'All', 0), ('seniority', 'Junior', 1), ('seniority', 'Mid-Level', 2),
    ('seniority', 'Senior', 3), ('seniority', 'Executive', 4),
    ('profile_seniority', 'Any', 0), ('profile_seniority', 'Junior', 1), ('profile_seniority', 'Mid-Level', 2),
    ('profile_seniority', 'Senior', 3), ('profile_seniority', 'Executive', 4),
    ('size', 'All', 0), ('size', '1 to 50 employees', 1), ('size', '51 to 200 employees', 2),
    ('size', '201 to 500 employees', 3), ('size', '501 to 1000 employees', 4),
    ('size', '1001 to 5000 employees', 5), ('size', '5001 to 10000 employees', 6),
    ('size', '10000+ employees', 7)) AS t(domain, value, pos)"""
    ]
)

FIT_BAND = """
  , f AS (
    SELECT regr_count(avg_salary, rating) AS n, regr_avgx(avg_salary, rating) AS mx,
      min(rating) AS x0, max(rating) AS x1,
      regr_slope(avg_salary, rating) AS b, regr_intercept(avg_salary, rating) AS a,
      regr_sxx(avg_salary, rating) AS sxx, regr_sxy(avg_salary, rating) AS sxy, regr_syy(avg_salary, rating) AS syy
    FROM d WHERE rating IS NOT NULL),
  t AS (
    SELECT *, sqrt((syy - sxy*sxy/sxx)/(n-2)) AS s, cast(n-2 AS double) AS v,
      cast(1.959963984540054 AS double) AS z FROM f WHERE n > 5),
  u AS (
    SELECT *, z + (z**3 + z)/4/v + (5*z**5 + 16*z**3 + 3*z)/96/(v*v)
      + (3*z**7 + 19*z**5 + 17*z**3 - 15*z)/384/(v*v*v)
      + (79*z**9 + 776*z**7 + 1482*z**5 - 1920*z**3 - 945*z)/92160/(v*v*v*v) AS tq FROM t),
  x AS (SELECT u.*, x0 + i*(x1-x0)/79 AS x FROM u, range(80) AS r(i))
  SELECT round(x, 6) AS x, round(a + b*x, 6) AS fit,
    round(a + b*x - tq*s*sqrt(1.0/n + (x-mx)*(x-mx)/sxx), 6) AS ci_lo,
    round(a + b*x + tq*s*sqrt(1.0/n + (x-mx)*(x-mx)/sxx), 6) AS ci_hi
  FROM x"""

SUMMARY = """
  SELECT count(*) AS n, round(avg(avg_salary), 6) AS avg, round(median(min_salary), 6) AS lo,
    round(median(max_salary), 6) AS hi FROM p"""

HISTOGRAM = """
  , s AS (SELECT count(*) AS total, avg(avg_salary) AS a, min(avg_salary) AS x0,
      (max(avg_salary) - min(avg_salary))/19 AS w FROM p),
  o AS (SELECT *, w/2 + floor((x0 - w/2)/w)*w AS origin FROM s WHERE total >= 5),
  b AS (SELECT least(greatest(ceil((avg_salary - origin)/w) - 1, 0), 19) AS bin, count(*) AS n
    FROM p, o GROUP BY 1)
  SELECT cast(i AS bigint) AS bin, round(origin + i*w, 6) AS x_lo, round(origin + (i+1)*w, 6) AS x_hi,
    coalesce(b.n, 0) AS n, round(a, 6) AS avg, total
  FROM o CROSS JOIN range(20) AS r(i) LEFT JOIN b ON b.bin = i"""

TOP_SECTORS = """
  , c AS (SELECT sector, count(*) AS n FROM p WHERE sector IS NOT NULL GROUP BY sector),
  k AS (SELECT *, rank() OVER (ORDER BY n DESC) AS r FROM c)
  SELECT sector, n, row_number() OVER (ORDER BY n, sector) AS pos FROM k WHERE r <= 8"""


def _gap(held: tuple[str, ...]) -> str:
    missing = [(i, flag, name) for i, (flag, name) in enumerate(SKILL_LIST, 1) if flag not in held]
    rows = " UNION ALL ".join(
        f"""SELECT '{name}' AS skill, {i} AS skill_pos,
    round((SELECT avg(avg_salary) FROM d WHERE {flag} = 1) - baseline, 6) AS gain,
    round(baseline, 6) AS baseline FROM base"""
        for i, flag, name in missing
    )
    return f"""
  , base AS (SELECT CASE WHEN (SELECT count(*) FROM p) >= 3 THEN (SELECT avg(avg_salary) FROM p)
      ELSE (SELECT avg(avg_salary) FROM d) END AS baseline),
  gaps AS ({rows})
  SELECT skill, gain, CASE WHEN gain >= 0 THEN 'positive' WHEN gain < 0 THEN 'negative' END AS dir, baseline,
    row_number() OVER (ORDER BY gain DESC NULLS LAST, skill_pos) AS pos FROM gaps"""


def _text(expr: str, digits: int) -> str:
    cast = f"cast(cast(round_even({expr}, {digits}) AS decimal(30,{digits})) AS varchar)"
    return f"regexp_replace({cast}, '[.]0+$', '')"


def _money(expr: str, digits: int = 0) -> str:
    return f"'$' || {_text(expr, digits)} || 'K'"


LABELS = f"""
  , k AS (SELECT count(*) AS n, round(median(avg_salary), 6) AS md, round(quantile_cont(avg_salary, 0.25), 6) AS q1,
      round(quantile_cont(avg_salary, 0.75), 6) AS q3, round(avg(sal_spread), 6) AS sp,
      avg(avg_salary) FILTER (WHERE same_state = 1) AS lo, avg(avg_salary) FILTER (WHERE same_state = 0) AS re,
      avg(python_yn)*100 AS py, avg(excel)*100 AS ex FROM g),
  st AS (SELECT job_state, round(median(avg_salary), 6) AS md, count(*) AS n FROM g GROUP BY job_state),
  pr AS (SELECT count(*) AS n, round(avg(avg_salary), 6) AS a, round(median(min_salary), 6) AS lo,
      round(median(max_salary), 6) AS hi FROM p),
  l AS (
  SELECT 'postings' AS kpi, format('{{:,}}', n) AS label FROM k
  UNION ALL SELECT 'median_salary', {_money('md', 1)} FROM k
  UNION ALL SELECT 'middle_half', {_money('q1')} || ' – ' || {_money('q3')} FROM k
  UNION ALL SELECT 'avg_spread', {_money('sp', 1)} FROM k
  UNION ALL SELECT 'local_avg', {_money('lo', 1)} FROM k
  UNION ALL SELECT 'remote_avg', {_money('re', 1)} FROM k
  UNION ALL SELECT 'python_share', {_text('py', 1)} || '%' FROM k
  UNION ALL SELECT 'excel_share', {_text('ex', 1)} || '%' FROM k
  UNION ALL SELECT 'top_paying_state', (SELECT job_state || ' (' || {_money('md')} || ')'
    FROM st WHERE n >= 3 ORDER BY md DESC, job_state LIMIT 1)
  UNION ALL SELECT 'busiest_state', (SELECT job_state || ' (' || n || ' jobs)' FROM st ORDER BY n DESC, job_state LIMIT 1)
  UNION ALL SELECT 'top_skill_demand', (SELECT skill || ' (' || {_text('demand', 0)} || '% of jobs)'
    FROM stats ORDER BY demand DESC, skill_pos LIMIT 1)
  UNION ALL SELECT 'top_skill_premium', (SELECT skill || ' (+' || {_money('premium', 1)} || ')'
    FROM stats ORDER BY premium DESC, skill_pos LIMIT 1)
  UNION ALL SELECT 'profile_matches', format('{{:,}}', n) FROM pr
  UNION ALL SELECT 'profile_avg', {_money('a', 1)} FROM pr
  UNION ALL SELECT 'profile_range', {_money('lo')} || ' – ' || {_money('hi')} FROM pr)
  SELECT kpi, coalesce(label, 'N/A') AS label FROM l"""


MEDIAN_STATS = "ms AS (" + " UNION ALL ".join(
    f"""SELECT '{name}' AS skill, {i} AS skill_pos, round(median(avg_salary) FILTER (WHERE {flag} = 1), 6) AS median_with,
    round(median(avg_salary) FILTER (WHERE {flag} = 0), 6) AS median_without,
    count(*) FILTER (WHERE {flag} = 1) AS n_with, count(*) FILTER (WHERE {flag} = 0) AS n_without FROM g"""
    for i, (flag, name) in enumerate(SKILL_LIST, 1)
) + """), mp AS (SELECT *, round(median_with - median_without, 6) AS premium FROM ms WHERE (SELECT count(*) FROM g) >= 1)"""
MEDIAN_PREMIUM = """SELECT skill, median_with, median_without, n_with, n_without, premium,
  CASE WHEN premium >= 0 THEN 'positive' WHEN premium < 0 THEN 'negative' END AS dir,
  coalesce(premium = max(premium) OVER (), false) AS is_best,
  row_number() OVER (ORDER BY premium NULLS LAST, skill_pos) AS pos FROM mp"""


def _sql(*ctes: str, body: str) -> str:
    # A body that begins with a comma goes on with further CTEs.
    return "WITH " + ",".join([RAW, CLEANED, *["\n" + c for c in ctes]]) + "\n" + body.strip() + "\n"


#: Results that are also made from stored cells; the SQL is the same.
REFRESHED = [
    "role_share", "busiest_state", "top_states_by_volume", "locality_avg", "skill_demand", "skill_premium", "skill_kpis",
    "skill_demand_by_role", "skill_cooccurrence", "profile_top_sectors", "skill_gap",
]


HIGHLIGHTS = [
    ("skill_demand_highlight", "skill_demand", "is_top"),
    ("skill_pair_highlight", "skill_cooccurrence", "is_max"),
    ("top_states_highlight", "top_states_by_volume", "is_top"),
]


def oracle_sql() -> dict[str, str]:
    found = _oracle_sql()
    for highlight, name, flag in HIGHLIGHTS:
        found[highlight] = f"SELECT * EXCLUDE ({flag}) FROM ({found[name]}) WHERE {flag}"
    return found | {f"refresh_{name}": found[name] for name in REFRESHED} | {"refresh_top_states_by_volume__narrow": found["top_states_by_volume__narrow"]}


def _oracle_sql() -> dict[str, str]:
    rated = "FROM d WHERE rating IS NOT NULL"
    enough = "(SELECT count(*) FROM d WHERE rating IS NOT NULL) > 5"
    return {
        "clean_postings": _sql(body="SELECT * FROM d"),
        "filter_domains": _sql(body=f"SELECT domain, value, cast(pos AS bigint) AS pos FROM ({DOMAINS})"),
        "salary_source_counts": _sql(body="SELECT sal_source, count(*) AS n FROM d GROUP BY sal_source"),
        "market_kpis": _sql(
            GLOBAL,
            body="""SELECT count(*) AS n, round(median(avg_salary), 6) AS median,
  round(quantile_cont(avg_salary, 0.25), 6) AS q1, round(quantile_cont(avg_salary, 0.75), 6) AS q3,
  round(avg(sal_spread), 6) AS avg_spread FROM g""",
        ),
        "market_kpis__narrow": _sql(
            GLOBAL_NARROW,
            body="""SELECT count(*) AS n, round(median(avg_salary), 6) AS median,
  round(quantile_cont(avg_salary, 0.25), 6) AS q1, round(quantile_cont(avg_salary, 0.75), 6) AS q3,
  round(avg(sal_spread), 6) AS avg_spread FROM g""",
        ),
        "market_kpis__no_upper_limit": _sql(
            GLOBAL_OPEN,
            body="""SELECT count(*) AS n, round(median(avg_salary), 6) AS median,
  round(quantile_cont(avg_salary, 0.25), 6) AS q1, round(quantile_cont(avg_salary, 0.75), 6) AS q3,
  round(avg(sal_spread), 6) AS avg_spread FROM g""",
        ),
        "top_states_by_salary__narrow": _sql(GLOBAL_NARROW, STATE_MEDIANS, body=TOP_STATES),
        "top_states_by_volume__narrow": _sql(GLOBAL_NARROW, STATE_COUNTS, body=BUSY_STATES),
        "profile_top_sectors__full": _sql(PROFILE_FULL + TOP_SECTORS, body=""),
        "skill_gap__all_skills": _sql(
            body="""SELECT cast(NULL AS varchar) AS skill, cast(NULL AS double) AS gain, cast(NULL AS varchar) AS dir,
  cast(NULL AS double) AS baseline, cast(NULL AS bigint) AS pos WHERE false"""
        ),
        "kpi_labels__none": _sql(GLOBAL_NONE, PROFILE, STATS + LABELS, body=""),
        "salary_range_by_role": _sql(GLOBAL, RANGES, body=RANGE_BY_ROLE),
        "salary_range_by_role__senior": _sql(GLOBAL_SENIOR, RANGES, body=RANGE_BY_ROLE),
        "top_role": _sql(GLOBAL, RANGES, body="SELECT role, mid, hi FROM ranges ORDER BY mid DESC, role LIMIT 1"),
        "role_share": _sql(
            GLOBAL,
            "c AS (SELECT role, count(*) AS n FROM g GROUP BY role)",
            body="""SELECT role, n, round(n * 100.0::double / sum(n) OVER (), 6) AS pct,
  round_even(n * 100.0::double / sum(n) OVER (), 1) AS pct_1dp,
  n = max(n) OVER () AS is_top, row_number() OVER (ORDER BY n, role) AS pos FROM c""",
        ),
        "seniority_share": _sql(
            GLOBAL,
            """c AS (SELECT seniority, seniority_rank, count(*) AS n, round(median(avg_salary), 6) AS median
  FROM g GROUP BY seniority, seniority_rank)""",
            body="""SELECT seniority, n, median, round(n * 100.0::double / sum(n) OVER (), 6) AS pct,
  round_even(n * 100.0::double / sum(n) OVER (), 1) AS pct_1dp,
  cast(seniority_rank AS bigint) AS seniority_rank FROM c""",
        ),
        "seniority_median": _sql(
            GLOBAL, body="SELECT seniority, round(median(avg_salary), 6) AS median FROM g GROUP BY seniority"
        ),
        "salary_box_by_seniority": _sql(
            GLOBAL + _box("seniority", "'Junior', 'Mid-Level', 'Senior', 'Executive'"), body=""
        ),
        "top_paying_state": _sql(
            GLOBAL, STATE_MEDIANS, body="SELECT * FROM states ORDER BY median DESC, job_state LIMIT 1"
        ),
        "busiest_state": _sql(GLOBAL, STATE_COUNTS, body="SELECT * FROM states ORDER BY n DESC, job_state LIMIT 1"),
        "locality_avg": _sql(
            GLOBAL,
            body="""SELECT round(avg(avg_salary) FILTER (WHERE same_state = 1), 6) AS local_avg,
  round(avg(avg_salary) FILTER (WHERE same_state = 0), 6) AS remote_avg FROM g""",
        ),
        "top_states_by_volume": _sql(
            GLOBAL,
            STATE_COUNTS,
            "k AS (SELECT *, rank() OVER (ORDER BY n DESC) AS r FROM states)",
            body="""SELECT job_state, n, n = max(n) OVER () AS is_top,
  row_number() OVER (ORDER BY n, job_state) AS pos FROM k WHERE r <= 15""",
        ),
        "top_states_by_salary": _sql(
            GLOBAL,
            STATE_MEDIANS,
            "k AS (SELECT *, rank() OVER (ORDER BY median DESC) AS r FROM states)",
            body="""SELECT job_state, median, n, median = max(median) OVER () AS is_top,
  row_number() OVER (ORDER BY median, job_state) AS pos FROM k WHERE r <= 15""",
        ),
        "salary_box_by_locality": _sql(GLOBAL + _box("locality", "'Same State', 'Different State'"), body=""),
        "locality_gap": _sql(
            GLOBAL,
            """m AS (SELECT count(*) AS n, round(median(avg_salary) FILTER (WHERE same_state = 1), 6) AS a,
  round(median(avg_salary) FILTER (WHERE same_state = 0), 6) AS b FROM g)""",
            body="""SELECT a AS local_median, b AS remote_median, round(abs(a - b), 6) AS gap,
  round_even(abs(a - b), 1) AS gap_1dp,
  CASE WHEN a >= b THEN 'Local' WHEN a < b THEN 'Out-of-state' END AS winner FROM m WHERE n > 0""",
        ),
        "locality_by_role": _sql(
            GLOBAL,
            body="SELECT role, locality, round(median(avg_salary), 6) AS median FROM g GROUP BY role, locality",
        ),
        "skill_demand": _sql(
            GLOBAL,
            STATS,
            body="""SELECT skill, demand, demand = max(demand) OVER () AS is_top,
  row_number() OVER (ORDER BY demand, skill_pos) AS pos FROM stats WHERE n > 0""",
        ),
        "skill_premium": _sql(
            GLOBAL,
            STATS,
            body="""SELECT skill, premium,
  CASE WHEN premium >= 0 THEN 'positive' WHEN premium < 0 THEN 'negative' END AS dir,
  coalesce(premium = max(premium) OVER (), false) AS is_best,
  row_number() OVER (ORDER BY premium NULLS LAST, skill_pos) AS pos FROM stats WHERE n > 0""",
        ),
        "top_skill_demand": _sql(
            GLOBAL, STATS, body="SELECT skill, demand FROM stats ORDER BY demand DESC NULLS LAST, skill_pos LIMIT 1"
        ),
        "top_skill_premium": _sql(
            GLOBAL, STATS, body="SELECT skill, premium FROM stats ORDER BY premium DESC NULLS LAST, skill_pos LIMIT 1"
        ),
        "skill_kpis": _sql(
            GLOBAL,
            body="SELECT round(avg(python_yn)*100, 6) AS python_pct, round(avg(excel)*100, 6) AS excel_pct FROM g",
        ),
        "skill_demand_by_role": _sql(
            GLOBAL,
            body="\nUNION ALL ".join(
                f"SELECT role, '{name}' AS skill, round(avg({flag})*100, 6) AS pct FROM g GROUP BY role"
                for flag, name in SKILL_LIST
            ),
        ),
        "skill_cooccurrence": _sql(
            GLOBAL,
            PAIRS,
            body="""SELECT skill_a, skill_b, pct,
  skill_a <> skill_b AND pct = max(CASE WHEN skill_a <> skill_b THEN pct END) OVER () AS is_max
FROM pairs WHERE n >= 10""",
        ),
        "salary_by_size": _sql("c AS (SELECT * FROM d)" + _level("size", "size_rank", "c"), body=""),
        "salary_by_size__filtered": _sql(
            "c AS (SELECT * FROM d WHERE ownership = 'BUILDING')" + _level("size", "size_rank", "c"), body=""
        ),
        "salary_by_age_group": _sql("c AS (SELECT * FROM d)" + _level("age_group", "age_rank", "c"), body=""),
        "salary_by_age_group__one_size": _sql(
            "c AS (SELECT * FROM d WHERE size = '51 to 200 employees')" + _level("age_group", "age_rank", "c"), body=""
        ),
        "salary_by_ownership": _sql(
            """m AS (SELECT ownership, round(median(avg_salary), 6) AS median, count(*) AS n
  FROM d WHERE ownership IS NOT NULL GROUP BY ownership HAVING count(*) >= 5)""",
            body="""SELECT ownership, median, n, median = max(median) OVER () AS is_top,
  row_number() OVER (ORDER BY median, ownership) AS pos FROM m""",
        ),
        "rating_regression": _sql(
            f"""f AS (SELECT regr_count(avg_salary, rating) AS n, avg(rating) AS avg_rating, min(avg_salary) AS min_salary,
  regr_slope(avg_salary, rating) AS slope, regr_intercept(avg_salary, rating) AS intercept,
  regr_r2(avg_salary, rating) AS r2 {rated})""",
            body="""SELECT cast(n AS bigint) AS n, round(avg_rating, 6) AS avg_rating, round(min_salary, 6) AS min_salary,
  round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2,
  round_even(avg_rating, 1) AS avg_rating_1dp, round_even(slope, 1) AS slope_1dp FROM f WHERE n > 5""",
        ),
        "rating_fit_band": _sql("c AS (SELECT 1)" + FIT_BAND, body=""),
        "rating_points": _sql(body=f"SELECT company_name, rating, avg_salary, role {rated} AND {enough}"),
        "rating_density": _sql(
            body=f"""SELECT round(floor(rating/cast(0.1 AS double) + 1e-9)*cast(0.1 AS double), 6) AS rating_bin,
  round(floor(avg_salary/10 + 1e-9)*10, 6) AS salary_bin, count(*) AS n {rated} AND {enough} GROUP BY 1, 2"""
        ),
        "profile_summary": _sql(PROFILE, body=SUMMARY),
        "profile_summary__any": _sql(PROFILE_ANY, body=SUMMARY),
        "profile_summary__full": _sql(PROFILE_FULL, body=SUMMARY),
        "profile_histogram": _sql(PROFILE + HISTOGRAM, body=""),
        "profile_histogram__any": _sql(PROFILE_ANY + HISTOGRAM, body=""),
        "profile_top_sectors": _sql(PROFILE + TOP_SECTORS, body=""),
        "profile_top_sectors__any": _sql(PROFILE_ANY + TOP_SECTORS, body=""),
        "skill_gap": _sql(PROFILE + _gap(("python_yn",)), body=""),
        "skill_gap__no_match": _sql(
            "p AS (SELECT * FROM d WHERE job_state = 'NOWHERE' AND python_yn = 1 AND spark = 1)"
            + _gap(("python_yn", "spark")),
            body="",
        ),
        "kpi_labels": _sql(GLOBAL, PROFILE, STATS + LABELS, body=""),
        "skill_median_premium": _sql(GLOBAL, MEDIAN_STATS, body=MEDIAN_PREMIUM),
        "skill_median_premium__narrow": _sql(GLOBAL_NARROW, MEDIAN_STATS, body=MEDIAN_PREMIUM),
        "salary_range_by_company": _sql(
            GLOBAL,
            """r AS (SELECT company_name, round(median(min_salary), 6) AS lo, round(median(avg_salary), 6) AS mid,
  round(median(max_salary), 6) AS hi, count(*) AS n FROM g GROUP BY company_name)""",
            body="SELECT *, row_number() OVER (ORDER BY mid, company_name) AS pos FROM r",
        ),
        "salary_box_by_company": _sql(
            GLOBAL,
            """q AS (SELECT company_name, count(*) AS n, quantile_cont(avg_salary, 0.25) AS q1, median(avg_salary) AS med,
  quantile_cont(avg_salary, 0.75) AS q3 FROM g GROUP BY company_name)""",
            body="""SELECT company_name, n, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
  round(least(q1, min(avg_salary) FILTER (WHERE avg_salary BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))), 2) AS whisker_lo,
  round(greatest(q3, max(avg_salary) FILTER (WHERE avg_salary BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))), 2) AS whisker_hi,
  count(*) FILTER (WHERE avg_salary < q1 - 1.5 * (q3 - q1) OR avg_salary > q3 + 1.5 * (q3 - q1)) AS n_outliers
  FROM g JOIN q USING (company_name) GROUP BY company_name, n, q1, med, q3""",
        ),
        "company_share": _sql(
            GLOBAL,
            "c AS (SELECT company_name, count(*) AS n FROM g GROUP BY company_name)",
            body="""SELECT company_name, n, round(n * 100.0::double / sum(n) OVER (), 6) AS pct,
  round_even(n * 100.0::double / sum(n) OVER (), 1) AS pct_1dp,
  n = max(n) OVER () AS is_top, row_number() OVER (ORDER BY n, company_name) AS pos FROM c""",
        ),
        "top_companies": _sql(
            GLOBAL,
            "c AS (SELECT company_name, count(*) AS n FROM g GROUP BY company_name)",
            body="SELECT company_name, n FROM (SELECT *, rank() OVER (ORDER BY n DESC) AS r FROM c) WHERE r <= 15",
        ),
        "sector_cooccurrence": _sql(
            GLOBAL,
            "held AS (SELECT DISTINCT company_name, job_state, sector FROM g WHERE sector IS NOT NULL)",
            "size AS (SELECT sector, count(*) AS n FROM held GROUP BY sector)",
            body="""SELECT a.sector AS item_a, b.sector AS item_b, count(*) AS n_both, any_value(x.n) AS n_a, any_value(y.n) AS n_b
  FROM held a JOIN held b ON a.company_name = b.company_name AND a.job_state = b.job_state AND a.sector < b.sector
  JOIN size x ON x.sector = a.sector JOIN size y ON y.sector = b.sector GROUP BY 1, 2 HAVING count(*) >= 2""",
        ),
        "skill_profile_holders": _sql(
            GLOBAL,
            "held AS (" + " UNION ".join(f"SELECT company_name, sector, '{name}' AS skill FROM g WHERE {flag} = 1" for flag, name in SKILL_LIST) + ")",
            """wanted(profile, skill) AS (VALUES ('analyst', 'Python'), ('analyst', 'Excel'), ('engineer', 'Python'), ('engineer', 'Spark'),
  ('engineer', 'AWS'), ('all', 'Python'), ('all', 'R'), ('all', 'Spark'), ('all', 'AWS'), ('all', 'Excel'))""",
            body="""SELECT company_name, sector, profile FROM (SELECT DISTINCT company_name, sector FROM held) o, (SELECT DISTINCT profile FROM wanted) p
  WHERE NOT EXISTS (SELECT 1 FROM wanted w WHERE w.profile = p.profile AND NOT EXISTS (
    SELECT 1 FROM held h WHERE h.company_name = o.company_name AND h.sector IS NOT DISTINCT FROM o.sector AND h.skill = w.skill))""",
        ),
        "salary_quantiles_two_phase": _sql(
            GLOBAL,
            body="""SELECT role, round(quantile_cont(avg_salary, 0.25), 6) AS q1,
  round(median(avg_salary), 6) AS median, round(quantile_cont(avg_salary, 0.75), 6) AS q3 FROM g GROUP BY role""",
        ),
    }
