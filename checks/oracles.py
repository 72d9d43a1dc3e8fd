"""SQL for each registered query, written plainly for a single-node engine."""

from __future__ import annotations

READS = ("fract_read", "cmssw_read", "xroot_read", "classad_read")
BASE_SIZES = ("allSize", "allOpsSize", "anaOpsSize")
OLD_SIZES = {"oldAllSize": "allSize", "oldAllOpsSize": "allOpsSize", "oldAnaOpsSize": "anaOpsSize"}
SIZES = (*BASE_SIZES, *OLD_SIZES)
WINDOWS = (90, 180, 365)
END_DATE = "DATE '2001-08-01'"
YOUNG_END_DATE = "DATE '1996-05-01'"

SIZE_COLUMNS = [f"{size}{w}" for w in WINDOWS for size in SIZES]
READ_COLUMNS = [f"{read}{w}" for w in WINDOWS for read in READS]

FILE_KEY = (
    "CAST(l_orderkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR) || '/' "
    "|| CAST(l_partkey AS VARCHAR)"
)
LOGGED_NAME = (
    f"(CASE WHEN l_discount = CAST(0.1 AS DOUBLE) THEN '/user/' ELSE '/store/' END) || {FILE_KEY}"
)
SITE = "'SITE_' || CAST(l_suppkey % 25 AS VARCHAR)"


def _columns(names: list[str], expression: str) -> str:
    return ", ".join(f"{expression.format(name)} AS {name}" for name in names)


def _age_sizes(end: str, disk: str = "disk") -> str:
    sums = []
    for w in WINDOWS:
        for size in BASE_SIZES:
            value = {
                "allSize": "rep_size",
                "allOpsSize": "(CASE WHEN br_user_group_id IN (42, 18, 19) THEN rep_size ELSE 0 END)",
                "anaOpsSize": "(CASE WHEN br_user_group_id = 42 THEN rep_size ELSE 0 END)",
            }[size]
            share = (
                f"CASE WHEN max_age > {w} OR min_age < 0 THEN 0 "
                f"ELSE (LEAST({w}, min_age) - GREATEST(0, max_age)) * {value} END"
            )
            sums.append(f"CAST(SUM({share}) AS DOUBLE) / {w} AS {size}{w}")
    olds = [
        f"CASE WHEN age > {w} THEN {base}{w} ELSE CAST(0 AS DOUBLE) END AS {old}{w}"
        for w in WINDOWS
        for old, base in OLD_SIZES.items()
    ]
    return f"""
        SELECT *, {", ".join(olds)} FROM (
          SELECT dataset_id, tier, age, {", ".join(sums)} FROM (
            SELECT r.*, split_part(dataset_name, '/', 4) AS tier,
                   date_diff('day', min_time, {end}) AS min_age,
                   date_diff('day', max_time, {end}) AS max_age,
                   date_diff('day', created, {end}) AS age
            FROM {disk} r JOIN (SELECT dataset_id AS created_id, MIN(replica_time_create) AS created
                                FROM {disk} GROUP BY dataset_id) ON dataset_id = created_id
          ) WHERE max_age <= {max(WINDOWS)}
          GROUP BY dataset_id, tier, age)"""


def _bin(value: str) -> str:
    return (
        f"CAST(CASE WHEN {value} IS NULL OR {value} = 0 THEN 0 "
        f"WHEN {value} > 0 AND {value} < 1.5 THEN 1 "
        f"WHEN {value} > 15 THEN 15 ELSE trunc({value}) END AS BIGINT)"
    )


def _read_windows(merged: str = "merged") -> str:
    sums = ", ".join(
        f"SUM(CASE WHEN date_diff('day', day, {END_DATE}) < {w} THEN {read} ELSE 0 END) AS {read}{w}"
        for w in WINDOWS
        for read in READS
    )
    bins = ", ".join(f"{_bin(name)} AS {name}" for name in READ_COLUMNS)
    return f"SELECT d_dataset_id, {bins} FROM (SELECT d_dataset_id, {sums} FROM {merged} GROUP BY 1)"


def _daily_reads(name: str, flag: str) -> str:
    return (
        f"SELECT l_partkey AS d_dataset_id, CAST(l_shipdate AS DATE) AS day, "
        f"SUM(l_quantity / 8.0) AS {name} FROM lineitem WHERE {flag} GROUP BY 1, 2"
    )


def _cells() -> str:
    cells = [
        f"SELECT '{size}' AS size, '{read}' AS read, {w} AS w, tier, "
        f"{read}{w} AS bin, {size}{w} AS bytes FROM overridden"
        for w in WINDOWS
        for size in SIZES
        for read in READS
    ]
    return " UNION ALL ".join(cells)


def _categories() -> str:
    tests = {
        "All": "TRUE",
        "sAODs": "lower(tier) LIKE '%aod%'",
        "sMINIAODs": "lower(tier) LIKE '%miniaod%'",
        "AODs": "lower(tier) LIKE 'aod%'",
        "notsAODs": "lower(tier) NOT LIKE '%aod%'",
    }
    return " UNION ALL ".join(
        f"SELECT 'sums_' || size || '_' || read || '_{name}_' || CAST(w AS VARCHAR) AS name, "
        f"bin, CASE WHEN {test} THEN bytes END AS bytes FROM cells"
        for name, test in tests.items()
    )


def _rolling(w: int) -> str:
    return f"""
        SELECT t.date AS date, r.size / NULLIF(t.size, 0) AS fraction, t.size AS size
        FROM (SELECT date, CAST(SUM(allOpsSize) AS DOUBLE) AS size FROM daily GROUP BY date) t
        JOIN (SELECT d.date, CAST(SUM(d.allOpsSize) AS DOUBLE) AS size
              FROM daily d
              JOIN (SELECT DISTINCT s.date, m.d_dataset_id FROM merged m
                    JOIN spine s ON s.date BETWEEN m.day AND m.day + {w}) u
                ON u.date = d.date AND u.d_dataset_id = d.dataset_id
              GROUP BY d.date) r ON r.date = t.date"""


# Shared steps, in the order they build on each other.
STEPS: dict[str, str] = {
    "catalog": """
        SELECT p_partkey AS d_dataset_id,
               '/' || replace(p_name, ' ', '_') || '/' ||
               (CASE p_size % 4 WHEN 0 THEN 'Run2018A-12Nov2019'
                                WHEN 1 THEN 'RunIIAutumn18-102X_v15_ext1'
                                WHEN 2 THEN 'RunIISummer16-94X_v3' ELSE 'CMSSW_10-102X' END)
               || '-v' || CAST(p_size % 3 + 1 AS VARCHAR) || '/' ||
               (CASE p_type WHEN 'ECONOMY' THEN 'AODSIM' WHEN 'SMALL' THEN 'MINIAODSIM'
                            WHEN 'MEDIUM' THEN 'GEN-SIM' WHEN 'LARGE' THEN 'AOD'
                            WHEN 'STANDARD' THEN 'NANOAOD' ELSE 'RAW' END)
               || '/' || CAST(p_partkey AS VARCHAR) AS d_dataset
        FROM part""",
    "files": f"""
        SELECT '/store/' || {FILE_KEY} AS f_logical_file_name, l_partkey AS f_dataset_id,
               CAST(MAX(l_quantity) AS BIGINT) AS f_event_count,
               CAST(MAX(l_extendedprice) AS DECIMAL(18,2)) AS f_file_size
        FROM lineitem GROUP BY l_orderkey, l_linenumber, l_partkey""",
    "totals": """
        SELECT d_dataset, d_dataset_id, CAST(SUM(f_file_size) AS DOUBLE) AS dsize,
               COUNT(*) AS nfiles, CAST(SUM(f_event_count) AS BIGINT) AS devts
        FROM files JOIN catalog ON f_dataset_id = d_dataset_id GROUP BY d_dataset, d_dataset_id""",
    "replicas": """
        SELECT d_dataset AS dataset_name, d_dataset_id AS dataset_id,
               CASE l_suppkey % 8 WHEN 0 THEN 'T3_US_A' WHEN 1 THEN 'X_TEST'
                    WHEN 2 THEN 'T1_DE_B_Buffer' WHEN 3 THEN 'T1_US_C_MSS'
                    WHEN 4 THEN 'T0_CH_D_Export'
                    ELSE 'T2_CH_' || CAST(l_suppkey AS VARCHAR) END AS node_name,
               CASE l_linenumber % 4 WHEN 0 THEN 42 WHEN 1 THEN 18 WHEN 2 THEN 19 ELSE 7 END
                 AS br_user_group_id,
               CAST(o_orderdate AS DATE) AS replica_time_create,
               CAST(l_shipdate AS DATE) AS min_time,
               CAST(l_shipdate AS DATE) + CAST(l_quantity AS INT) AS max_time,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS rep_size
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        JOIN catalog ON l_partkey = d_dataset_id""",
    "disk": """
        SELECT * FROM replicas
        WHERE node_name NOT LIKE 'T3%' AND node_name NOT LIKE 'X%' AND node_name NOT LIKE '%Buffer'
          AND node_name NOT LIKE '%MSS' AND node_name NOT LIKE '%Export'""",
    "spine": """
        SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31',
                                           INTERVAL 1 DAY)) AS DATE) AS date""",
    "daily": """
        SELECT date, dataset_id,
               SUM(CASE WHEN br_user_group_id IN (42, 18, 19) THEN rep_size ELSE 0 END) AS allOpsSize
        FROM disk JOIN spine ON date BETWEEN min_time AND max_time GROUP BY date, dataset_id""",
    "cmssw": _daily_reads("cmssw_read", "l_returnflag = 'R'"),
    "xroot": _daily_reads("xroot_read", "l_returnflag = 'A'"),
    "classad": _daily_reads("classad_read", "l_returnflag NOT IN ('R', 'A')"),
    "merged": """
        SELECT d_dataset_id, day, cmssw_read, xroot_read, classad_read,
               GREATEST(cmssw_read, xroot_read, classad_read) AS fract_read
        FROM cmssw FULL JOIN xroot USING (d_dataset_id, day)
        FULL JOIN classad USING (d_dataset_id, day)""",
    "bins": _read_windows(),
    "overrides": """
        SELECT p_partkey AS d_dataset_id, CAST(p_partkey % 16 AS INT) AS value
        FROM part WHERE p_brand = 'Brand#11'""",
    "sizes": _age_sizes(END_DATE),
    "young_sizes": _age_sizes(YOUNG_END_DATE),
    "exact_sizes": (
        "SELECT dataset_id, tier, "
        + _columns(SIZE_COLUMNS, "CAST(round({0}, 6) AS DECIMAL(28,6))")
        + " FROM sizes"
    ),
    "popularity": (
        "SELECT COALESCE(dataset_id, d_dataset_id) AS dataset_id, tier, "
        + ", ".join(SIZE_COLUMNS)
        + ", "
        + _columns(READ_COLUMNS, "COALESCE({0}, 0)")
        + " FROM exact_sizes FULL JOIN bins ON dataset_id = d_dataset_id"
    ),
    "overridden": (
        "SELECT dataset_id, tier, value, "
        + ", ".join(SIZE_COLUMNS)
        + ", "
        + _columns(READ_COLUMNS, "COALESCE(value, {0})")
        + " FROM popularity FULL JOIN overrides ON dataset_id = d_dataset_id"
    ),
    "unused": """
        SELECT d_dataset, allSize90, allSize180, allSize365
        FROM (SELECT * FROM overridden WHERE fract_read180 < 1
              ORDER BY allSize180 DESC NULLS LAST, dataset_id LIMIT 5000)
        JOIN catalog ON dataset_id = d_dataset_id""",
    "cells": _cells(),
    "histogram": (
        "SELECT name, "
        + ", ".join(
            f'CAST(COALESCE(SUM(CASE WHEN bin = {i} THEN bytes END), 0) AS DOUBLE) AS "{i}"'
            for i in range(16)
        )
        + f" FROM ({_categories()}) GROUP BY name"
    ),
}


STEPS |= {
    "spans": """
        SELECT d_dataset AS dataset_name, d_dataset_id AS dataset_id, replica_time_create, node_name,
               SUM(block_size) AS rep_size, min_time, max_time, br_user_group_id
        FROM (SELECT user_id % 20 + 1 AS known,
                     DATE '2019-01-01' + CAST(user_id % 7 AS INTEGER) AS replica_time_create,
                     'T2_' || event_type || CASE WHEN user_id % 5 = 0 THEN '_MSS' ELSE '' END
                       AS node_name,
                     CASE user_id % 4 WHEN 0 THEN 42 WHEN 1 THEN 18 WHEN 2 THEN 19 ELSE 7 END
                       AS br_user_group_id,
                     MIN(CAST(ts AS DATE)) AS min_time, MAX(CAST(ts AS DATE)) AS max_time,
                     CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / COUNT(*) AS block_size
              FROM events GROUP BY user_id, event_type)
        JOIN catalog ON known = d_dataset_id
        GROUP BY d_dataset, d_dataset_id, replica_time_create, node_name, min_time, max_time,
                 br_user_group_id""",
    "spans_disk": "SELECT * FROM spans WHERE node_name NOT LIKE '%MSS'",
    "event_spine": """
        SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-12-31',
                                           INTERVAL 1 DAY)) AS DATE) AS date""",
    "spans_sizes": _age_sizes("DATE '2024-12-01'", "spans_disk"),
}


def _with(select: str) -> str:
    """``select`` after the steps it needs, directly or through other steps."""
    needed: set[str] = set()
    texts = [select]
    while texts:
        words = set(texts.pop().replace("(", " ").replace(")", " ").replace(",", " ").split())
        for name in STEPS.keys() & words - needed:
            needed.add(name)
            texts.append(STEPS[name])
    steps = [f"{name} AS MATERIALIZED ({sql})" for name, sql in STEPS.items() if name in needed]
    return f"WITH {', '.join(steps)} {select}" if steps else select


_SPANS = """
    SELECT dataset_name, dataset_id, replica_time_create, node_name,
           round(SUM(block_size), 6) AS rep_size,
           strftime(min_day, '%Y%m%d') AS min_time, strftime(max_day, '%Y%m%d') AS max_time,
           br_user_group_id
    FROM (SELECT '/set/' || CAST(user_id % 20 AS VARCHAR) AS dataset_name,
                 CAST(user_id % 20 AS INTEGER) AS dataset_id,
                 CAST(20190101 + user_id % 7 AS VARCHAR) AS replica_time_create,
                 'T2_' || event_type AS node_name,
                 CASE user_id % 4 WHEN 0 THEN 42 WHEN 1 THEN 18 WHEN 2 THEN 19 ELSE 7 END
                   AS br_user_group_id,
                 MIN(CAST(ts AS DATE)) AS min_day, MAX(CAST(ts AS DATE)) AS max_day,
                 CAST(SUM(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / COUNT(*) AS block_size
          FROM events GROUP BY user_id, event_type)
    GROUP BY dataset_name, dataset_id, replica_time_create, node_name, min_day, max_day,
             br_user_group_id"""

_FILE_TALLY = """
    SELECT a.d_dataset_id, strftime(day, '%Y%m%d') AS day, {dim}, nfiles_read,
           CAST(size_read AS DOUBLE) AS size_read, CAST(size_read AS DOUBLE) / dsize AS fract_read
    FROM (SELECT f_dataset_id AS d_dataset_id, CAST(l_shipdate AS DATE) AS day, {keys},
                 SUM(f_file_size) AS size_read, COUNT(*) AS nfiles_read
          FROM (SELECT {name} AS file_lfn, * FROM lineitem)
          JOIN files ON file_lfn = f_logical_file_name
          WHERE {where} GROUP BY ALL) a
    JOIN totals t ON a.d_dataset_id = t.d_dataset_id"""

_DAILY_ACCESS = _FILE_TALLY.format(
    name=LOGGED_NAME,
    dim="site_name",
    keys=f"{SITE} AS site_name, l_linestatus = 'O' AS crab",
    where="l_returnflag = 'R'",
)

_DOMAINS = _FILE_TALLY.format(
    name=LOGGED_NAME,
    dim="client_domain",
    keys=(
        "CASE WHEN l_discount = CAST(0.05 AS DOUBLE) THEN NULL "
        "WHEN l_discount = CAST(0.06 AS DOUBLE) THEN NULL "
        "ELSE 'site' || CAST(l_linenumber AS VARCHAR) || '.net' END AS client_domain"
    ),
    where="l_returnflag = 'A' AND l_tax <> 0",
)

_HOT_FILE = _FILE_TALLY.format(
    name=(
        "CASE WHEN l_discount = CAST(0.07 AS DOUBLE) "
        f"THEN (SELECT MIN(f_logical_file_name) FROM files) ELSE {LOGGED_NAME} END"
    ),
    dim="site_name",
    keys=f"{SITE} AS site_name",
    where="l_returnflag = 'R'",
)

_UNSPOILT = _FILE_TALLY.format(
    name=LOGGED_NAME,
    dim="site_name",
    keys=f"{SITE} AS site_name",
    where="l_returnflag = 'R' AND round(l_tax * 100) NOT IN (3, 4, 5)",
)

_BROKEN = """
    SELECT CASE round(l_tax * 100) WHEN 4 THEN 'no data' ELSE 'malformed' END AS reason, COUNT(*) AS n,
           COUNT(DISTINCT CASE round(l_tax * 100) WHEN 4 THEN 'null' WHEN 3 THEN CAST(l_orderkey AS VARCHAR)
                 ELSE {name} || {site} END) AS texts
    FROM lineitem WHERE l_returnflag = 'R' AND round(l_tax * 100) IN (3, 4, 5) GROUP BY 1""".format(
    name=LOGGED_NAME, site=SITE
)

_LINE_TOTALS = """
    SELECT COUNT(*) AS lines, CAST(SUM(CASE WHEN round(l_tax * 100) IN (3, 4, 5) THEN 1 ELSE 0 END) AS BIGINT) AS broken,
           CAST(SUM(CASE WHEN round(l_tax * 100) NOT IN (3, 4, 5) AND l_discount <> CAST(0.1 AS DOUBLE) THEN 1 ELSE 0 END)
                AS BIGINT) AS counted
    FROM lineitem WHERE l_returnflag = 'R'"""

_EVENTS = f"""
    SELECT j.d_dataset_id, strftime(day, '%Y%m%d') AS day, sum_evts, nrecs, site_name,
           1000 * sum_evts / CAST(1 + devts AS DOUBLE) AS fract_read
    FROM (SELECT l_partkey AS d_dataset_id, CAST(l_shipdate AS DATE) AS day,
                 CASE WHEN l_tax <> CAST(0.01 AS DOUBLE) AND l_linestatus = 'O' THEN {SITE}
                      ELSE 'Remote' END AS site_name,
                 SUM(l_quantity) AS sum_evts, COUNT(*) AS nrecs
          FROM lineitem
          WHERE l_returnflag NOT IN ('R', 'A') AND l_tax <> 0 AND l_discount <> CAST(0.1 AS DOUBLE)
          GROUP BY ALL) j
    JOIN totals t ON j.d_dataset_id = t.d_dataset_id"""

_DISK = """
    SELECT dataset_name, node_name, br_user_group_id, replica_time_create, min_time, max_time,
           CAST(rep_size AS DOUBLE) AS rep_size FROM disk"""

_DAILY = "SELECT date, dataset_id, CAST(allOpsSize AS DOUBLE) AS allOpsSize FROM daily"

_INPUT_CAMPAIGN = (
    r"regexp_extract(d_dataset, "
    r"'^/[^/]*/((?:HI|PA|PN|XeXe|)Run201\d\w-[^-]+|CMSSW_\d+|[^-]+)[^/]*/', 1)"
)

_TAPE_CAMPAIGN = "regexp_replace(pieces[1] || '-' || pieces[len(pieces) - 1], '_ext1$', '')"

_TAPE = """
    SELECT split_part(dataset_name, '/', 4) AS tier,
           """ + _TAPE_CAMPAIGN + """ AS input_campaign,
           CAST(SUM(rep_size) AS DOUBLE) AS size
    FROM (SELECT *, string_split(split_part(dataset_name, '/', 3), '-') AS pieces FROM replicas)
    WHERE node_name LIKE '%MSS' {active} GROUP BY 1, 2"""

_CATALOG_REPLICAS = """
    SELECT {site} AS RSE_ID, f_dataset_id, l_linestatus AS SCOPE,
           strftime({tally}, '%Y%m%d') AS tally_day,
           strftime(CAST(l_shipdate AS DATE) - 5, '%Y%m%d') AS create_day,
           CAST(SUM(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS rep_size
    FROM (SELECT {name} AS name, * FROM lineitem) JOIN files ON name = f_logical_file_name
    GROUP BY ALL"""

_MERGED = "SELECT d_dataset_id, day, fract_read, cmssw_read, xroot_read, classad_read FROM merged"

_POPULARITY = (
    "SELECT dataset_id, tier, {more}"
    + _columns(SIZE_COLUMNS, "CAST({0} AS DOUBLE)")
    + ", "
    + _columns(READ_COLUMNS, "CAST({0} AS BIGINT)")
    + " FROM {table}"
)

_OVERRIDE_DAILY = """
    SELECT date, CAST(SUM(allOpsSize) AS DOUBLE) AS size
    FROM daily JOIN overrides ON dataset_id = d_dataset_id GROUP BY date"""

_UNUSED = """
    SELECT d_dataset, CAST(allSize90 AS DOUBLE) AS allSize90,
           CAST(allSize180 AS DOUBLE) AS allSize180, CAST(allSize365 AS DOUBLE) AS allSize365
    FROM {table}"""

_UNUSED_CAMPAIGN = (
    "regexp_replace(regexp_replace(split_part(d_dataset, '/', 3), '-[^-]*$', ''), "
    "'(_v[^_]*){1,3}$', '')"
)

_BY_CAMPAIGN = f"""
    SELECT {_UNUSED_CAMPAIGN} AS campaign, CAST(SUM(allSize365) AS DOUBLE) / 1e12 AS tb
    FROM unused GROUP BY 1"""

_SIZE_CHECK = f"""
    SELECT CAST(SUM(rep_size) AS DOUBLE) AS rep_size,
           CAST(SUM(CASE WHEN br_user_group_id IN (42, 18, 19) THEN rep_size ELSE 0 END)
                AS DOUBLE) AS allOpsSize,
           CAST(SUM(CASE WHEN br_user_group_id = 42 THEN rep_size ELSE 0 END)
                AS DOUBLE) AS anaOpsSize
    FROM disk WHERE max_time = {END_DATE}"""

def _tallied(name: str, tally: str) -> str:
    return (
        f"SELECT d_dataset_id, day, SUM(CAST(round(fract_read, 9) AS DECIMAL(18,9))) AS {name} "
        f"FROM ({tally}) GROUP BY 1, 2"
    )


# Named after the tallies are: each is a step of its own, with the days as dates for the windows.
STEPS |= {
    "tally_cmssw": _tallied("cmssw_read", _DAILY_ACCESS),
    "tally_xroot": _tallied("xroot_read", _DOMAINS),
    "tally_classad": _tallied("classad_read", _EVENTS),
    "tally_merged": """
        SELECT d_dataset_id, day AS day_text, CAST(strptime(day, '%Y%m%d') AS DATE) AS day,
               cmssw_read, xroot_read, classad_read,
               GREATEST(cmssw_read, xroot_read, classad_read) AS fract_read
        FROM tally_cmssw FULL JOIN tally_xroot USING (d_dataset_id, day)
        FULL JOIN tally_classad USING (d_dataset_id, day)""",
    "tally_bins": _read_windows("tally_merged"),
}

_TOTALS = "SELECT d_dataset, d_dataset_id, dsize, nfiles, devts FROM totals"

_PERIODS = """
    (SELECT s_suppkey AS period_id, first_day, first_day + CAST(s_nationkey * 3 - 3 AS INT) AS last_day
     FROM (SELECT *, DATE '1995-01-01' + CAST(s_suppkey * 17 % 2400 AS INT) AS first_day FROM supplier))"""

_ALIVE = f"""
    SELECT period_id, COUNT(*) AS replicas, COUNT(DISTINCT dataset_name) AS datasets,
           CAST(SUM(rep_size) AS DOUBLE) AS rep_size,
           CAST(SUM(rep_size * (LEAST(max_time, last_day) - GREATEST(min_time, first_day) + 1)) AS DOUBLE) AS byte_days
    FROM {_PERIODS} JOIN disk ON min_time <= last_day AND max_time >= first_day
    WHERE first_day <= last_day AND min_time <= max_time GROUP BY period_id"""

_OVERLAPPING = """
    SELECT d.node_name, r.node_name AS other_node_name, COUNT(*) AS n
    FROM disk d JOIN replicas r ON d.dataset_name = r.dataset_name
     AND d.min_time <= r.max_time AND r.min_time <= d.max_time
    WHERE r.node_name LIKE 'T3%' OR r.node_name LIKE 'X%' OR r.node_name LIKE '%Buffer'
       OR r.node_name LIKE '%MSS' OR r.node_name LIKE '%Export'
    GROUP BY 1, 2"""

_FAULTY = """
    (SELECT CASE WHEN p_size <> 7 THEN d_dataset_id END AS d_dataset_id, d_dataset
     FROM catalog JOIN part ON d_dataset_id = p_partkey
     UNION ALL
     SELECT -d_dataset_id, d_dataset FROM catalog JOIN part ON d_dataset_id = p_partkey
     WHERE p_brand = 'Brand#11')"""

_VIOLATIONS = f"""
    SELECT 'dataset names' AS name, 'doubled' AS kind, d_dataset AS key, COUNT(*) AS n
    FROM {_FAULTY} GROUP BY d_dataset HAVING COUNT(*) > 1
    UNION ALL
    SELECT 'dataset ids', 'null', 'NULL', COUNT(*) FROM {_FAULTY} WHERE d_dataset_id IS NULL HAVING COUNT(*) > 0
    UNION ALL
    SELECT 'owners of files', 'missing', CAST(f_dataset_id AS VARCHAR), COUNT(*) FROM files
    WHERE f_dataset_id NOT IN (SELECT d_dataset_id FROM {_FAULTY} WHERE d_dataset_id IS NOT NULL)
    GROUP BY f_dataset_id"""

_SKETCHED = """
    SELECT CAST(month(ts) AS BIGINT) AS month, COUNT(*) AS n, COUNT(DISTINCT user_id) AS users,
           TRUE AS users_close, TRUE AS low_close, TRUE AS high_close
    FROM events GROUP BY 1"""

_CASES = {
    "dataset_totals": _TOTALS,
    "daily_access": _DAILY_ACCESS,
    "daily_access_domains": _DOMAINS,
    "daily_access_events": _EVENTS,
    "daily_access_from_json": _DAILY_ACCESS,
    "daily_access_hot_file": _HOT_FILE,
    "daily_access_quarantined": _UNSPOILT,
    "quarantined_lines": _BROKEN,
    "log_line_totals": _LINE_TOTALS,
    "dataset_totals_bucketed": _TOTALS,
    "bucket_layout": """
        SELECT COUNT(*) AS n, CAST(0 AS BIGINT) AS misplaced, CAST(0 AS BIGINT) AS unsorted FROM files""",
    "dataset_totals_from_csv": _TOTALS,
    "replica_spans_folded": _SPANS,
    "alive_during": _ALIVE,
    "overlapping_lifetimes": _OVERLAPPING,
    "key_violations": _VIOLATIONS,
    "key_violation_totals": f"""
        SELECT name, kind, COUNT(*) AS keys, CAST(SUM(n) AS BIGINT) AS n FROM ({_VIOLATIONS}) GROUP BY name, kind""",
    "sketched_months": _SKETCHED,
    "compaction_by_size": _DISK,
    "merged_months_refreshed": f"{_MERGED} WHERE year(day) BETWEEN 1997 AND 1999",
    "replica_spans": _SPANS,
    "replica_spans_from_csv": _SPANS,
    "disk_replicas": _DISK,
    "spans_to_disk": """
        SELECT dataset_name, node_name, br_user_group_id,
               strftime(replica_time_create, '%Y%m%d') AS replica_time_create, min_time, max_time,
               round(rep_size, 4) AS rep_size FROM spans_disk""",
    "spans_to_daily_size": """
        SELECT date, dataset_id,
               round(SUM(CASE WHEN br_user_group_id IN (42, 18, 19) THEN rep_size ELSE 0 END), 4)
                 AS allOpsSize
        FROM spans_disk JOIN event_spine ON date BETWEEN min_time AND max_time
        GROUP BY date, dataset_id""",
    "spans_to_windows": (
        "SELECT dataset_id, tier, " + _columns(SIZE_COLUMNS, "round({0}, 4)") + " FROM spans_sizes"
    ),
    "spans_to_tape": _TAPE.replace("CAST(SUM(rep_size) AS DOUBLE)", "round(SUM(rep_size), 4)")
    .replace("FROM replicas", "FROM spans")
    .format(active="AND max_time > DATE '2024-01-02'"),
    "tape_usage_from_csv": _TAPE.replace(
        "CAST(SUM(rep_size) AS DOUBLE)", "round(CAST(SUM(rep_size) AS DOUBLE), 2)"
    ).format(active=""),
    "tallies_merged": "SELECT d_dataset_id, day_text AS day, "
    + _columns(["fract_read", "cmssw_read", "xroot_read", "classad_read"], "CAST({0} AS DOUBLE)")
    + " FROM tally_merged",
    "tallies_to_windows": f"SELECT d_dataset_id, {', '.join(READ_COLUMNS)} FROM tally_bins",
    "daily_access_domains_from_json": _DOMAINS,
    "daily_access_events_from_json": _EVENTS,
    "overrides_from_json": "SELECT d_dataset_id, value FROM overrides",
    "daily_size_sweep": _DAILY,
    "daily_size": _DAILY,
    "daily_size_explode": _DAILY,
    "daily_size_sorted": _DAILY,
    "replica_windows": f"SELECT dataset_id, tier, {', '.join(SIZE_COLUMNS)} FROM sizes",
    "replica_windows_young": f"SELECT dataset_id, tier, {', '.join(SIZE_COLUMNS)} FROM young_sizes",
    "tape_usage": _TAPE.format(active=""),
    "tape_usage_active": _TAPE.format(active=f"AND max_time > {END_DATE}"),
    "catalog_replicas_daily": _CATALOG_REPLICAS.format(
        site=SITE, name=LOGGED_NAME, tally="CAST(l_shipdate AS DATE)"
    ),
    "catalog_replicas_hot_file": _CATALOG_REPLICAS.format(
        site=SITE,
        name=(
            "CASE WHEN CAST(round(l_extendedprice * 100) AS BIGINT) % 9 = 4 "
            f"THEN (SELECT MIN(f_logical_file_name) FROM files) ELSE {LOGGED_NAME} END"
        ),
        tally="CAST(l_shipdate AS DATE)",
    ),
    "catalog_replicas_from_files": _CATALOG_REPLICAS.format(
        site=SITE, name=LOGGED_NAME, tally="CAST(l_shipdate AS DATE)"
    ),
    "merge_reads": _MERGED,
    "merged_reads_by_month": _MERGED,
    "read_windows": f"SELECT d_dataset_id, {', '.join(READ_COLUMNS)} FROM bins",
    "quantize": f"""
        SELECT amount, {_bin('amount')} AS bin, COUNT(*) AS n
        FROM (SELECT (l_quantity - 10) / 2.0 AS amount FROM lineitem) GROUP BY 1, 2""",
    "overrides_resolved": "SELECT d_dataset_id, value FROM overrides",
    "popularity_joined": _POPULARITY.format(more="", table="popularity"),
    "overrides_applied": _POPULARITY.format(more="value, ", table="overridden"),
    "override_daily": _OVERRIDE_DAILY,
    "override_daily_csv": _OVERRIDE_DAILY,
    "top_unused": _UNUSED.format(table="unused"),
    "top_unused_25": _UNUSED.format(
        table="""(SELECT * FROM overridden WHERE fract_read90 < 1
                  ORDER BY allSize90 DESC NULLS LAST, dataset_id LIMIT 25)
                 JOIN catalog ON dataset_id = d_dataset_id"""
    ),
    "unused_by_campaign": _BY_CAMPAIGN,
    "unused_by_campaign_csv": _BY_CAMPAIGN,
    "popularity_histogram_wide": "SELECT * FROM histogram",
    "popularity_histogram_json": "SELECT * FROM histogram",
    "popularity_histogram_long": " UNION ALL ".join(
        f'SELECT name, CAST({i} AS INTEGER) AS bin, "{i}" AS bytes FROM histogram'
        for i in range(16)
    ),
    "rolling_popularity_30": _rolling(30),
    "rolling_popularity_90": _rolling(90),
    "rolling_popularity_180": _rolling(180),
    "rolling_popularity_windows": " UNION ALL ".join(
        f'SELECT CAST({w} AS INTEGER) AS "window", * FROM ({_rolling(w)})' for w in (30, 90, 180)
    ),
    "dataset_names": f"""
        SELECT d_dataset_id, split_part(d_dataset, '/', 4) AS tier,
               {_INPUT_CAMPAIGN} AS input_campaign, {_TAPE_CAMPAIGN} AS tape_campaign,
               {_UNUSED_CAMPAIGN} AS unused_campaign
        FROM (SELECT *, string_split(split_part(d_dataset, '/', 3), '-') AS pieces FROM catalog)""",
    "input_campaign": f"""
        SELECT {_INPUT_CAMPAIGN} AS input_campaign, COUNT(*) AS n FROM catalog GROUP BY 1""",
    "tape_campaign": f"""
        SELECT {_TAPE_CAMPAIGN} AS tape_campaign, COUNT(*) AS n
        FROM (SELECT string_split(split_part(d_dataset, '/', 3), '-') AS pieces FROM catalog)
        GROUP BY 1""",
    "tier_categories": """
        SELECT d_dataset_id, TRUE AS "All", tier LIKE '%aod%' AS "sAODs",
               tier LIKE '%miniaod%' AS "sMINIAODs", tier LIKE 'aod%' AS "AODs",
               tier NOT LIKE '%aod%' AS "notsAODs"
        FROM (SELECT d_dataset_id, lower(split_part(d_dataset, '/', 4)) AS tier FROM catalog)""",
    "epoch_days": """
        SELECT strftime(o_orderdate, '%Y%m%d') AS day, strftime(o_orderdate, '%Y%m%d') AS ms_day,
               COUNT(*) AS n FROM orders GROUP BY 1, 2""",
    "date_spine": """
        SELECT CAST(unnest(generate_series(first, last, INTERVAL 1 DAY)) AS DATE) AS date
        FROM (SELECT MIN(CAST(o_orderdate AS DATE)) AS first, MAX(CAST(o_orderdate AS DATE)) AS last
              FROM orders)""",
    "size_check": _SIZE_CHECK,
    "size_check_catalogued": _SIZE_CHECK,
    "window_totals": (
        "SELECT " + _columns(SIZE_COLUMNS, "CAST(SUM({0}) AS DOUBLE)") + " FROM exact_sizes"
    ),
    "null_counts": "SELECT "
    + _columns(["d_dataset_id", "day", *READS], "COUNT(*) - COUNT({0})")
    + " FROM merged",
    "compaction_roundtrip": _DISK,
}

ORACLE_SQL: dict[str, str] = {name: _with(select) for name, select in _CASES.items()}
