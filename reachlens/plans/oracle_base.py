"""Shared SQL fragments of the DuckDB checks: the logical tables as CTEs over the given tables."""

from __future__ import annotations

# Example selection, equal to ``queries.SELECTION``.
CLIENT, METRIC = 3, "ADGRP"
OLDER = "TG_KEY = 1 AND MARKET_KEY = 1"
NEWER = "TG_KEY = 12 AND MARKET_KEY = 1"
WEEKS = "WEEK_KEY >= 199601 AND WEEK_KEY <= 199652"


def week_no(day: str) -> str:
    new_year = f"date_trunc('year', {day})::DATE"
    return (
        f"CAST((date_diff('day', {new_year}, {day}) + isodow({new_year}) + 1) // 7 AS INTEGER)"
    )


def week_key(day: str) -> str:
    return f"CAST(year({day}) * 100 + {week_no(day)} AS INTEGER)"


TG = (
    "CAST((CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END)"
    " + (CASE WHEN l_linestatus = 'O' THEN 10 ELSE 0 END) AS INTEGER)"
)
MARKET = "CAST(substr(o_orderpriority, 1, 1) AS INTEGER)"

GENRES = """
genres AS (
  SELECT p_type, CAST(row_number() OVER (ORDER BY p_type) AS INTEGER) AS genre_no
  FROM (SELECT DISTINCT p_type FROM part)
)"""

FACT = f"""{GENRES},
fact AS (
  SELECT g.genre_no AS GENRE_KEY, p.p_type AS GENRE_DISPLAY_NAME,
    s.s_nationkey AS NETWORK_KEY,
    CASE WHEN s.s_nationkey >= 20 THEN 'Others' ELSE sn.n_name END AS NETWORK_DISPLAY_NAME,
    l.l_suppkey AS CHANNEL_GROUP_KEY, s.s_name AS CHANNEL_GROUP_DISPLAY_NAME,
    l.l_partkey AS PROGRAM_GROUP_KEY, p.p_name AS PROGRAM_GROUP_DISPLAY_NAME,
    c.c_nationkey AS ADVERTISERS_GROUP_KEY, cn.n_name AS ADVERTISERS_GROUP_DISPLAY_NAME,
    {TG} AS TG_KEY, {MARKET} AS MARKET_KEY,
    CAST(year(l_shipdate) AS INTEGER) AS CALENDAR_YEAR,
    CAST(week(l_shipdate) AS INTEGER) AS BARC_WEEK,
    upper(strftime(l_shipdate, '%b')) AS MONTH,
    {week_key("l_shipdate::DATE")} AS WEEK_KEY,
    CAST(l_quantity AS DECIMAL(15,2)) AS ADGRP,
    CAST(l_extendedprice AS DECIMAL(15,2)) AS FCT,
    CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2))) AS TVT
  FROM lineitem l
  JOIN orders o ON o.o_orderkey = l.l_orderkey
  JOIN customer c ON c.c_custkey = o.o_custkey
  JOIN part p ON p.p_partkey = l.l_partkey
  JOIN genres g ON g.p_type = p.p_type
  JOIN supplier s ON s.s_suppkey = l.l_suppkey
  JOIN nation sn ON sn.n_nationkey = s.s_nationkey
  JOIN nation cn ON cn.n_nationkey = c.c_nationkey
)"""

SUMS = "sum(ADGRP) AS ADGRP, sum(FCT) AS FCT, sum(TVT) AS TVT"
SUMS_OUT = "CAST(ADGRP AS DOUBLE) AS ADGRP, CAST(FCT AS DOUBLE) AS FCT, CAST(TVT AS DOUBLE) AS TVT"


def program(source: str = "fact", name: str = "program") -> str:
    return f"""
{name} AS (
  SELECT GENRE_KEY, NETWORK_KEY, CHANNEL_GROUP_KEY, TG_KEY, MARKET_KEY, WEEK_KEY, ADVERTISERS_GROUP_KEY,
    max(GENRE_DISPLAY_NAME) AS GENRE_DISPLAY_NAME, max(NETWORK_DISPLAY_NAME) AS NETWORK_DISPLAY_NAME,
    max(CHANNEL_GROUP_DISPLAY_NAME) AS CHANNEL_GROUP_DISPLAY_NAME,
    max(ADVERTISERS_GROUP_DISPLAY_NAME) AS ADVERTISERS_GROUP_DISPLAY_NAME, {SUMS}
  FROM {source}
  GROUP BY GENRE_KEY, NETWORK_KEY, CHANNEL_GROUP_KEY, TG_KEY, MARKET_KEY, WEEK_KEY, ADVERTISERS_GROUP_KEY
)"""


def genre_channel(source: str = "program", name: str = "genre_channel") -> str:
    return f"""
{name} AS (
  SELECT GENRE_KEY, NETWORK_KEY, CHANNEL_GROUP_KEY, TG_KEY, MARKET_KEY, WEEK_KEY,
    max(GENRE_DISPLAY_NAME) AS GENRE_DISPLAY_NAME, max(NETWORK_DISPLAY_NAME) AS NETWORK_DISPLAY_NAME,
    max(CHANNEL_GROUP_DISPLAY_NAME) AS CHANNEL_GROUP_DISPLAY_NAME, {SUMS}
  FROM {source}
  GROUP BY GENRE_KEY, NETWORK_KEY, CHANNEL_GROUP_KEY, TG_KEY, MARKET_KEY, WEEK_KEY
)"""


def show(source: str = "fact", name: str = "show_prog") -> str:
    return f"""
{name} AS (
  SELECT TG_KEY, MARKET_KEY, PROGRAM_GROUP_KEY, CHANNEL_GROUP_KEY, WEEK_KEY,
    max(PROGRAM_GROUP_DISPLAY_NAME) AS PROGRAM_GROUP_DISPLAY_NAME,
    max(CHANNEL_GROUP_DISPLAY_NAME) AS CHANNEL_GROUP_DISPLAY_NAME,
    max(NETWORK_DISPLAY_NAME) AS NETWORK_DISPLAY_NAME, max(GENRE_DISPLAY_NAME) AS GENRE_DISPLAY_NAME, {SUMS}
  FROM {source}
  GROUP BY TG_KEY, MARKET_KEY, PROGRAM_GROUP_KEY, CHANNEL_GROUP_KEY, WEEK_KEY
)"""


def _cells(key: str) -> str:
    return (
        f"CAST({key} % 3 + 1 + o.off AS INTEGER) AS TG_KEY, CAST({key} % 5 + 1 AS INTEGER) AS MARKET_KEY,"
        " CASE WHEN o.off = 0 THEN 'CUST_SALES' ELSE 'CUST_SALES/BARC' END AS SOURCE,"
        f" 'TG ' || ({key} % 3 + 1 + o.off) AS TG_DISPLAY_NAME, 'MKT ' || ({key} % 5 + 1) AS MARKET_DISPLAY_NAME,"
        f" 'TG ' || ({key} % 3 + 1 + o.off) || ' MKT ' || ({key} % 5 + 1) AS TG_MARKET_DISPLAY_NAME"
    )


REF_GENRE = f"""
ref_genre AS (
  SELECT genre_no AS GENRE_KEY, upper(p_type) AS GENRE_NAME, p_type AS GENRE_DISPLAY_NAME, {_cells("genre_no")}
  FROM genres, (VALUES (0), (10)) o(off)
)"""

REF_CHANNEL = f"""
ref_channel AS (
  SELECT s_suppkey AS CHANNEL_GROUP_KEY, s_name AS CHANNEL_GROUP_DISPLAY_NAME, {_cells("s_suppkey")}
  FROM supplier, (VALUES (0), (10)) o(off)
)"""

REF_TG_MKT = f"""
ref_tg_mkt AS (
  SELECT DISTINCT 'TG ' || {TG} AS TG_DISPLAY_NAME, 'MKT ' || {MARKET} AS MARKET_DISPLAY_NAME,
    'TG ' || {TG} || ' MKT ' || {MARKET} AS TG_MARKET_DISPLAY_NAME, {TG} AS TG_KEY, {MARKET} AS MARKET_KEY,
    CASE WHEN {TG} < 10 THEN 'CUST_SALES' ELSE 'CUST_SALES/BARC' END AS SOURCE
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey
)"""

SHOW_BASE = """
show_base AS (
  SELECT a.TG_KEY, a.MARKET_KEY, a.PROGRAM_GROUP_KEY, a.CHANNEL_GROUP_KEY, a.WEEK_KEY,
    a.PROGRAM_GROUP_DISPLAY_NAME, a.CHANNEL_GROUP_DISPLAY_NAME, a.ADGRP, a.FCT, a.TVT
  FROM show_prog a JOIN ref_channel r ON r.CHANNEL_GROUP_KEY = a.CHANNEL_GROUP_KEY
    AND r.TG_KEY = a.TG_KEY AND r.MARKET_KEY = a.MARKET_KEY
)"""

CHANNEL_BASE = """
channel_base AS (
  SELECT a.CHANNEL_GROUP_KEY, a.CHANNEL_GROUP_DISPLAY_NAME, a.TG_KEY, a.MARKET_KEY, a.GENRE_KEY,
    a.GENRE_DISPLAY_NAME, a.WEEK_KEY, a.ADGRP, a.FCT, a.TVT
  FROM genre_channel a JOIN ref_channel r ON r.CHANNEL_GROUP_KEY = a.CHANNEL_GROUP_KEY
    AND r.TG_KEY = a.TG_KEY AND r.MARKET_KEY = a.MARKET_KEY
)"""

GENRE_BASE = f"""
genre_base AS (
  SELECT a.GENRE_KEY, a.NETWORK_KEY, a.WEEK_KEY, max(a.GENRE_DISPLAY_NAME) AS GENRE_DISPLAY_NAME,
    max(a.NETWORK_DISPLAY_NAME) AS NETWORK_DISPLAY_NAME, {SUMS}
  FROM genre_channel a JOIN ref_genre r ON r.GENRE_KEY = a.GENRE_KEY
    AND r.TG_KEY = a.TG_KEY AND r.MARKET_KEY = a.MARKET_KEY
  GROUP BY a.GENRE_KEY, a.NETWORK_KEY, a.WEEK_KEY
)"""

# category, level, category key, level key, totals table, advertiser table, base table
LEVELS = {
    "genre": (
        "GENRE_DISPLAY_NAME",
        "NETWORK_DISPLAY_NAME",
        "GENRE_KEY",
        "NETWORK_KEY",
        "genre_channel",
        "program",
        "genre_base",
    ),
    "channel": (
        "CHANNEL_GROUP_DISPLAY_NAME",
        "GENRE_DISPLAY_NAME",
        "CHANNEL_GROUP_KEY",
        "GENRE_KEY",
        "genre_channel",
        "program",
        "channel_base",
    ),
    "show": (
        "PROGRAM_GROUP_DISPLAY_NAME",
        "CHANNEL_GROUP_DISPLAY_NAME",
        "CHANNEL_GROUP_KEY",
        "PROGRAM_GROUP_KEY",
        "show_prog",
        "fact",
        "show_base",
    ),
}


def _once(
    keys: str, columns: str, table: str, value: str, cells: tuple[str, str], extra: str = "", metric: str = METRIC
) -> str:
    """Distinct union of the two cells' grouped sums."""
    branches = [
        f"SELECT {columns}, sum({metric}) AS {value} FROM {table} WHERE {cell} AND {WEEKS} {extra} GROUP BY {keys}"
        for cell in cells
    ]
    return " UNION ".join(branches)


def affinity(level: str, older: str = OLDER, newer: str = NEWER, metric: str = METRIC) -> str:
    """The four two-stage totals and their join, as a CTE named ``affinity``."""
    category, name, cat_key, level_key, totals, client, _ = LEVELS[level]
    cells = (older, newer)
    of_client = f"AND ADVERTISERS_GROUP_KEY = {CLIENT}"
    keys = f"{cat_key}, {level_key}, GENRE_DISPLAY_NAME, NETWORK_DISPLAY_NAME"
    columns = (
        f"{cat_key} AS cat_key, {level_key} AS level_key, max({category}) AS category, max({name}) AS level,"
        " GENRE_DISPLAY_NAME AS genre, NETWORK_DISPLAY_NAME AS ntwk"
    )
    genre = "GENRE_DISPLAY_NAME AS genre"
    client_columns = f"{cat_key} AS cat_key, {level_key} AS level_key"
    return f"""
prog_all AS (
  SELECT cat_key, level_key, max(category) AS category, max(level) AS level, max(genre) AS genre,
    max(ntwk) AS ntwk, sum(v) AS prog_metric
  FROM ({_once(keys, columns, totals, "v", cells, metric=metric)}) GROUP BY cat_key, level_key
),
prog_share AS (
  SELECT genre, sum(v) AS metric_share
  FROM ({_once("GENRE_DISPLAY_NAME", genre, "genre_channel", "v", cells, metric=metric)}) GROUP BY genre
),
client_metric AS (
  SELECT cat_key, level_key, sum(v) AS client_metric
  FROM ({_once(f"{cat_key}, {level_key}", client_columns, client, "v", cells, of_client, metric)})
  GROUP BY cat_key, level_key
),
client_share AS (
  SELECT genre, sum(v) AS client_share
  FROM ({_once("GENRE_DISPLAY_NAME", genre, "program", "v", cells, of_client, metric)}) GROUP BY genre
),
affinity AS (
  SELECT a.category, a.level, a.cat_key, a.level_key, a.prog_metric, s.metric_share, c.client_metric,
    cs.client_share, a.genre, a.ntwk
  FROM prog_all a JOIN prog_share s ON a.genre = s.genre
  LEFT JOIN client_metric c ON a.cat_key = c.cat_key AND a.level_key = c.level_key
  LEFT JOIN client_share cs ON a.genre = cs.genre
)"""


def denominator(level: str, name: str = "denom") -> str:
    category, level_name, *_, base = LEVELS[level]
    return f"""
{name} AS (
  SELECT {category} AS category, {level_name} AS level, sum({METRIC}) AS affinity_denom
  FROM {base} WHERE {WEEKS} GROUP BY ALL
)"""


def ratio(part: str, whole: str) -> str:
    return f"CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0) * 100"


def enriched() -> str:
    """Enriched frame as a CTE named ``enriched``; needs ``affinity`` and ``denom``."""
    return f"""
named AS (
  SELECT category, level, genre, ntwk, sum(prog_metric) AS prog_metric,
    avg(metric_share) AS metric_share, sum(client_metric) AS client_metric, avg(client_share) AS client_share
  FROM affinity
  WHERE category IS NOT NULL AND level IS NOT NULL AND genre IS NOT NULL AND ntwk IS NOT NULL
  GROUP BY category, level, genre, ntwk
),
client_total AS (SELECT sum(client_metric) AS total FROM named),
enriched AS (
  SELECT n.category, n.level, CAST(n.prog_metric AS DOUBLE) AS prog_metric,
    {ratio("n.prog_metric", "n.metric_share")} AS genre_share,
    {ratio("n.prog_metric", "d.affinity_denom")} AS affinity,
    CAST(n.client_metric AS DOUBLE) AS client_metric,
    {ratio("n.client_metric", "n.client_share")} AS client_genre_share,
    CASE WHEN t.total > 0 THEN {ratio("n.client_metric", "t.total")} END AS overall_share,
    n.genre, n.ntwk
  FROM named n CROSS JOIN client_total t
  LEFT JOIN denom d ON d.category = n.category AND d.level = n.level
  WHERE coalesce(t.total, 0) <> 0
)"""


def level_ctes(level: str, older: str = OLDER, newer: str = NEWER, metric: str = METRIC) -> list[str]:
    """Everything up to ``affinity`` for one level."""
    parts = [FACT, program(), genre_channel()]
    if level == "show":
        parts.append(show())
    return [*parts, affinity(level, older, newer, metric)]


def enriched_ctes(level: str) -> list[str]:
    base = {
        "genre": [REF_GENRE, GENRE_BASE],
        "channel": [REF_CHANNEL, CHANNEL_BASE],
        "show": [REF_CHANNEL, SHOW_BASE],
    }[level]
    return [*level_ctes(level), *base, denominator(level), enriched()]


def channel_enriched_ctes() -> list[str]:
    """The channel insight frame as CTE ``channels``; only needs the fact and roll-ups."""
    def branch(cell: str) -> str:
        def side(table: str, value: str, names: str, extra: str) -> str:
            return (
                f"SELECT {names} GENRE_KEY AS cat_key, CHANNEL_GROUP_KEY AS level_key, sum({METRIC}) AS {value}"
                f" FROM {table} WHERE {cell} AND {WEEKS} {extra} GROUP BY GENRE_KEY, CHANNEL_GROUP_KEY"
            )

        names = (
            "max(NETWORK_DISPLAY_NAME) AS ntwk, max(CHANNEL_GROUP_DISPLAY_NAME) AS category,"
            " max(GENRE_DISPLAY_NAME) AS level,"
        )
        client = side("program", "client_metric", names, f"AND ADVERTISERS_GROUP_KEY = {CLIENT}")
        totals = side("genre_channel", "prog_metric", "", "")
        return (
            f"SELECT c.*, p.prog_metric FROM ({client}) c JOIN ({totals}) p"
            " ON c.cat_key = p.cat_key AND c.level_key = p.level_key"
        )

    return [
        f"""
chnl AS (
  SELECT max(category) AS category, max(level) AS level, cat_key, level_key, max(ntwk) AS ntwk,
    sum(client_metric) AS client_metric, sum(prog_metric) AS prog_metric
  FROM ({branch(OLDER)} UNION {branch(NEWER)}) GROUP BY cat_key, level_key
)""",
        REF_CHANNEL,
        CHANNEL_BASE,
        denominator("channel", "chnl_denom"),
        f"""
chnl_named AS (
  SELECT category, level, ntwk, sum(client_metric) AS client_metric, sum(prog_metric) AS prog_metric
  FROM chnl WHERE category IS NOT NULL AND level IS NOT NULL AND ntwk IS NOT NULL GROUP BY ALL
),
chnl_total AS (SELECT sum(client_metric) AS total FROM chnl_named),
channels AS (
  SELECT n.category, n.level, CAST(n.client_metric AS DOUBLE) AS client_metric,
    CAST(n.prog_metric AS DOUBLE) AS prog_metric, n.ntwk,
    CASE WHEN t.total > 0 THEN {ratio("n.client_metric", "t.total")} END AS overall_share,
    {ratio("n.prog_metric", "d.affinity_denom")} AS affinity
  FROM chnl_named n CROSS JOIN chnl_total t
  LEFT JOIN chnl_denom d ON d.category = n.category AND d.level = n.level
)""",
    ]


def query(ctes: list[str], select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join(ctes)}\n{select}"
