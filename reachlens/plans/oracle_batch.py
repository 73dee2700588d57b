"""DuckDB SQL of the calendar, table, list, scope and news queries."""

from __future__ import annotations

from reachlens.plans import oracle_base as o

_GENRE_CHANNEL = [o.FACT, o.program(), o.genre_channel()]

# --- calendar and week keys ---

_REPAIRED = "(199552, 199653, 199752, 199953, 200052)"
_KEYED = "keyed AS (SELECT * REPLACE (CAST(CALENDAR_YEAR * 100 + BARC_WEEK AS INTEGER) AS WEEK_KEY) FROM fact)"
_REPAIR = f"""repaired AS (
  SELECT * REPLACE (
    CAST(CASE WHEN WEEK_KEY IN {_REPAIRED} AND MONTH = 'JAN' THEN CALENDAR_YEAR - 1 ELSE CALENDAR_YEAR END AS INTEGER)
      AS CALENDAR_YEAR,
    CAST(CASE WHEN WEEK_KEY IN {_REPAIRED} AND MONTH = 'JAN' THEN WEEK_KEY - 100 ELSE WEEK_KEY END AS INTEGER)
      AS WEEK_KEY)
  FROM keyed
)"""
_SHIFT = """shifted AS (
  SELECT * EXCLUDE (year_after) REPLACE (
    CAST(year_after * 100 + BARC_WEEK AS INTEGER) AS WEEK_KEY, year_after AS CALENDAR_YEAR)
  FROM (
    SELECT *, CAST(CALENDAR_YEAR - CASE WHEN MONTH IN ('JUL', 'AUG', 'SEP', 'OCT', 'NOV', 'DEC')
      OR (MONTH = 'JAN' AND BARC_WEEK >= 50) THEN 1 ELSE 0 END AS INTEGER) AS year_after FROM fact
  )
)"""


def _by_week(table: str, where: str = "true") -> str:
    return f"""SELECT CALENDAR_YEAR, MONTH, WEEK_KEY, count(*) AS n, CAST(sum(ADGRP) AS DOUBLE) AS ADGRP,
      CAST(sum(FCT) AS DOUBLE) AS FCT, CAST(sum(TVT) AS DOUBLE) AS TVT
      FROM {table} WHERE {where} GROUP BY CALENDAR_YEAR, MONTH, WEEK_KEY"""


def _week_saturday(year: str, week: str) -> str:
    new_year = f"make_date({year}, 1, 1)"
    return f"CAST({new_year} + CAST((7 - isodow({new_year})) % 7 + 7 * ({week} - 1) + 6 AS INTEGER) AS DATE)"


def _end_date(key: str) -> str:
    before = f"CAST({key} // 100 - 1 AS BIGINT)"
    last = f"make_date({before}, 12, 31)"
    return (
        f"CASE WHEN {key} % 100 >= 1 THEN {_week_saturday(f'CAST({key} // 100 AS BIGINT)', f'({key} % 100 - 1)')}"
        f" ELSE {_week_saturday(before, o.week_no(last))} END"
    )


def _label(day: str) -> str:
    return f"isoyear({day}) || ' Week ' || lpad(CAST({o.week_no(day)} AS VARCHAR), 2, '0')"


_DATES = f"""dates AS (
  SELECT CAST(strftime(d, '%Y%m%d') AS INTEGER) AS DATE_KEY, d AS PRG_DATE, {o.week_no("d")} AS BARC_WEEK,
    CAST(year(d) AS INTEGER) AS BARC_YEAR
  FROM (
    SELECT CAST(unnest(generate_series(
      date_trunc('year', min(l_shipdate))::TIMESTAMP, make_date(year(max(l_shipdate)), 12, 31)::TIMESTAMP,
      INTERVAL 1 DAY
    )) AS DATE) AS d FROM lineitem
  )
)"""
_WEEK_DATES = """SELECT BARC_WEEK || '-' || BARC_YEAR AS WEEK_YEAR,
  CAST(BARC_YEAR * 100 + BARC_WEEK AS INTEGER) AS WEEK_KEY, max(DATE_KEY) AS DATE_KEY
  FROM dates GROUP BY BARC_YEAR, BARC_WEEK"""


def _sums(table: str) -> str:
    return f"SELECT * EXCLUDE (ADGRP, FCT, TVT), {o.SUMS_OUT} FROM {table}"


def _stacked(**tables: str) -> str:
    parts = [f"SELECT '{name}' AS name, * EXCLUDE (ADGRP, FCT, TVT), {o.SUMS_OUT} FROM {table}" for name, table in tables.items()]
    return " UNION ALL BY NAME ".join(parts)


def _by_table_and_week(fact: str, where: str = "TRUE") -> str:
    """Rows and sums of every weekly table by week, from a fact with week keys."""
    names = {
        "program": "program",
        "genre_channel": "genre_channel",
        "show": "show_prog",
        "show_base": "show_base",
        "channel_base": "channel_base",
        "genre_base": "genre_base",
    }
    sums = ", ".join(f"CAST(sum({metric}) AS DOUBLE) AS {metric}" for metric in ("ADGRP", "FCT", "TVT"))
    parts = [f"SELECT '{n}' AS name, WEEK_KEY, count(*) AS n, {sums} FROM {t} WHERE {where} GROUP BY WEEK_KEY" for n, t in names.items()]
    ctes = [o.FACT, _KEYED, _REPAIR, o.program(fact), o.genre_channel(), o.show(fact)]
    return o.query([*ctes, o.REF_CHANNEL, o.REF_GENRE, o.SHOW_BASE, o.CHANNEL_BASE, o.GENRE_BASE], " UNION ALL ".join(parts))


# --- lists and parameters ---

_CLIENTS = """clients AS (
  SELECT c_nationkey AS key, max(n_name) AS name FROM customer JOIN orders ON o_custkey = c_custkey
  JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1
)"""
_CHOSEN = "chosen AS (SELECT n_name AS name FROM nation UNION ALL SELECT s_name FROM supplier)"

# --- hierarchy ---


def _key_lists(pairs: str, most: int = 1000) -> str:
    """Texts of at most so many keys by their places, from distinct (name, key) pairs."""
    order = "TRY_CAST(key AS BIGINT) NULLS FIRST, key"
    return f"""SELECT name, part, string_agg(key, ';' ORDER BY {order}) AS keys FROM (
        SELECT name, key, (row_number() OVER (PARTITION BY name ORDER BY {order}) - 1) // {most} AS part FROM ({pairs})
      ) GROUP BY name, part"""


_STAFF = """staff AS (
  SELECT e.s_suppkey AS key, e.s_name AS name, m.s_name AS manager_name,
    CASE WHEN e.s_suppkey > 0 THEN e.s_suppkey // 3 END AS manager,
    CASE WHEN e.s_suppkey = 0 THEN 'HO GROUP'
      WHEN NOT EXISTS (SELECT 1 FROM supplier r WHERE r.s_suppkey > 0 AND r.s_suppkey // 3 = e.s_suppkey)
        THEN 'SALES EXECUTIVE'
      WHEN e.s_suppkey <= 3 THEN 'CLUSTER HEAD' ELSE 'BRANCH HEAD' END AS role,
    CASE WHEN e.s_suppkey % 7 <> 0 THEN '-' END AS second_role,
    'Group ' || (e.s_suppkey % 4 + 1) AS auth_group
  FROM supplier e LEFT JOIN supplier m ON e.s_suppkey > 0 AND m.s_suppkey = e.s_suppkey // 3
)"""
_ACCESS = """access AS (
  SELECT DISTINCT l_suppkey AS key, CAST(l_partkey % 20 AS VARCHAR) AS channel,
    'Channel ' || (l_partkey % 20) AS channel_name, CAST(s_nationkey AS VARCHAR) AS location
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  UNION ALL SELECT 0, 'ALL', 'ALL', CAST(s_nationkey AS VARCHAR) FROM supplier WHERE s_suppkey = 0
)"""
_CLOSURE = """closure AS (
  SELECT e.key, m.key AS manager, upper(m.name) AS manager_name
  FROM (SELECT DISTINCT key FROM access) a JOIN staff e ON e.key = a.key
  JOIN staff m ON m.key = e.manager WHERE m.role <> 'HO GROUP'
  UNION
  SELECT c.key, m.key, upper(m.name) FROM closure c JOIN staff e ON e.key = c.manager
  JOIN staff m ON m.key = e.manager WHERE m.role <> 'HO GROUP'
)"""
_SCOPE = """scopes AS (
  SELECT 'U' || key AS EMPLOYEE_NT_ID, 'all' AS scope, NULL::VARCHAR AS EMPLOYEE_KEY FROM staff WHERE role = 'HO GROUP'
  UNION SELECT 'U' || key, 'listed', CAST(key AS VARCHAR) FROM staff WHERE role <> 'HO GROUP'
  UNION SELECT 'U' || manager, 'listed', CAST(key AS VARCHAR) FROM closure
)"""
_ACCESS_OUT = """CAST(key AS VARCHAR) AS EMPLOYEE_KEY, channel AS CHANNEL_GROUP_KEY,
  channel_name AS CHANNEL_GROUP_DISPLAY_NAME, location AS LOCATION_KEY"""
_HIERARCHY = [_STAFF, _ACCESS, _CLOSURE]

_DASHBOARDS = """dashboards(auth_group, dashboard) AS (
  SELECT 'Group ' || g, 'region_' || r FROM range(1, 5) a(g), range(0, 5) b(r) WHERE r % g = 0
  UNION ALL SELECT 'Group ' || g, 'market_view' FROM range(1, 4) a(g)
  UNION ALL SELECT 'Group ' || g, 'team_view' FROM range(1, 3) a(g)
  UNION ALL SELECT 'Group 1', 'own_view'
)"""

_ENTITLED = """SELECT 'U' || key AS EMPLOYEE_NT_ID, dashboard FROM staff JOIN dashboards USING (auth_group)
  WHERE NOT (dashboard = 'own_view' AND role <> 'SALES EXECUTIVE')
    AND NOT (dashboard = 'team_view' AND role = 'SALES EXECUTIVE')
    AND NOT (dashboard = 'market_view' AND auth_group = 'Group 1'
      AND role NOT IN ('CLUSTER HEAD', 'BRANCH HEAD', 'HO GROUP'))"""

# --- news ---

_NEWS = """news AS (
  SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS Title,
    TIMESTAMP '2024-01-01' + to_hours(page_id) AS PublishDate, url AS Link,
    regexp_extract(url, '^https?://([^/]+)', 1) AS Source,
    regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS SearchTerm
  FROM pages
)"""
_NEWS_TEXT = "strftime(PublishDate, '%Y-%m-%d %H:%M:%S') AS PublishDate"
_NEWS_OUT = f"Title, {_NEWS_TEXT}, Link, Source, SearchTerm"
_NOW = "TIMESTAMP '2024-01-08'"
_PARSED = """parsed AS (
  SELECT trim(Title) AS Title, PublishDate, Link, Source, SearchTerm, page_id // 100 AS feed_no,
    CAST(row_number() OVER (PARTITION BY SearchTerm, page_id // 100 ORDER BY page_id) - 1 AS INTEGER) AS position
  FROM news
)"""
_TERMS = "terms AS (SELECT DISTINCT SearchTerm AS term FROM news UNION ALL SELECT n_name FROM nation)"

ORACLES: dict[str, str] = {
    "week_key_from_date": f"""SELECT day, {o.week_no("day")} AS week, {o.week_key("day")} AS week_key,
        CAST(isoyear(day) * 100 + {o.week_no("day")} AS INTEGER) AS week_key_iso_year,
        {_label("day")} || ' To ' || {_label("(day + 7)")} AS label, strftime(day, '%Y/%m/%d') AS slash_date
      FROM (SELECT DISTINCT l_shipdate::DATE AS day FROM lineitem)""",
    "week_repair": o.query([o.FACT, _KEYED, _REPAIR], _by_week("repaired")),
    "week_shift_older": o.query([o.FACT, _SHIFT], _by_week("shifted")),
    "week_retention": o.query([o.FACT], _by_week("fact", "WEEK_KEY > (SELECT max(WEEK_KEY) - 200 FROM fact)")),
    "max_week": o.query([o.FACT], "SELECT max(WEEK_KEY) AS max_week FROM fact"),
    "default_end_date": o.query(
        [o.FACT],
        f"""SELECT max_week, end_date, CAST(isoyear(end_date) * 100 + {o.week_no("end_date")} AS INTEGER) AS week_key,
          {_label("end_date")} || ' To ' || {_label("end_date")} AS label
        FROM (SELECT max_week, {_end_date("max_week")} AS end_date FROM (SELECT max(WEEK_KEY) AS max_week FROM fact))""",
    ),
    "end_date_per_week": o.query(
        [o.FACT], f"SELECT WEEK_KEY, {_end_date('WEEK_KEY')} AS end_date FROM (SELECT DISTINCT WEEK_KEY FROM fact)"
    ),
    "latest_dates": """SELECT 'revenue' AS fact, max(o_orderdate)::DATE AS max_date FROM orders
      JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
      UNION ALL SELECT 'break', max(l_shipdate)::DATE FROM lineitem""",
    "week_to_date_key": o.query([_DATES], _WEEK_DATES),
    "date_range_keys": o.query(
        [_DATES],
        "SELECT PRG_DATE, DATE_KEY FROM dates WHERE PRG_DATE BETWEEN DATE '1996-11-20' AND DATE '1997-02-14'",
    ),
    "week_range_keys": o.query([_DATES], f"""SELECT * FROM ({_WEEK_DATES}) WHERE WEEK_KEY
      BETWEEN {o.week_key("DATE '1996-11-20'")} AND {o.week_key("DATE '1997-02-14'")}"""),
    "period_validation": """SELECT days // 7 + 1 <= 52 AS dashboard, days <= 168 AS revenue,
        days // 7 + 1 <= 13 AS ratings, count(*) AS n
      FROM (
        SELECT date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS days
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey
      ) GROUP BY ALL""",
    "incremental_week_rebuild": o.query([o.FACT, _KEYED, _REPAIR, o.program("repaired")], _sums("program")),
    "incremental_base_rebuild": o.query(
        [o.FACT, _KEYED, _REPAIR, o.program("repaired"), o.genre_channel(), o.REF_GENRE, o.GENRE_BASE],
        _sums("genre_base"),
    ),
    "incremental_table_rebuild": o.query(
        [
            *[o.FACT, _KEYED, _REPAIR, o.program("repaired"), o.genre_channel(), o.show("repaired")],
            *[o.REF_CHANNEL, o.SHOW_BASE, o.CHANNEL_BASE],
        ],
        _stacked(show="show_prog", show_base="show_base", channel_base="channel_base"),
    ),
    "weekly_contents": o.query(
        [*_GENRE_CHANNEL, o.show(), o.REF_CHANNEL, o.REF_GENRE, o.SHOW_BASE, o.CHANNEL_BASE, o.GENRE_BASE],
        _stacked(
            program="program",
            genre_channel="genre_channel",
            show="show_prog",
            show_base="show_base",
            channel_base="channel_base",
            genre_base="genre_base",
        ),
    ),
    "weekly_build": o.query(
        [*_GENRE_CHANNEL, o.show(), o.REF_CHANNEL, o.REF_GENRE, o.SHOW_BASE, o.CHANNEL_BASE, o.GENRE_BASE],
        " UNION ALL ".join(
            f"SELECT '{name}' AS name, count(*) AS n FROM {table}"
            for name, table in (
                ("program", "program"),
                ("genre_channel", "genre_channel"),
                ("show", "show_prog"),
                ("show_base", "show_base"),
                ("channel_base", "channel_base"),
                ("genre_base", "genre_base"),
            )
        ),
    ),
    "published_builds": f"""SELECT *, 0 AS build FROM ({_by_table_and_week("keyed")})
      UNION ALL SELECT *, 1 AS build FROM ({_by_table_and_week("repaired")})""",
    "published_retention": _by_table_and_week("keyed", "WEEK_KEY > (SELECT max(WEEK_KEY) - 200 FROM keyed)"),
    "dates_as_text": o.query(
        [_DATES],
        "SELECT DATE_KEY::VARCHAR AS DATE_KEY, PRG_DATE::VARCHAR AS PRG_DATE, BARC_WEEK::VARCHAR AS BARC_WEEK,"
        " BARC_YEAR::VARCHAR AS BARC_YEAR FROM dates",
    ),
    "client_list": o.query([_CLIENTS], "SELECT * FROM clients"),
    "client_list_revenue": """SELECT c_nationkey AS key, max(n_name) AS name FROM orders
      JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""",
    "client_list_fallback": o.query(
        [_CLIENTS], "SELECT *, 'aggregate' AS origin FROM clients UNION ALL SELECT *, 'table' FROM clients"
    ),
    "genre_list": f"WITH {o.GENRES} SELECT genre_no AS key, p_type AS name FROM genres",
    "genre_pick_list": f"WITH {o.GENRES} SELECT genre_no AS key, upper(p_type) AS name FROM genres",
    "program_first_keys": "SELECT p_name AS name, min(l_partkey) AS key FROM lineitem"
    " JOIN part ON p_partkey = l_partkey GROUP BY 1",
    "cell_pick_list": f"WITH {o.REF_TG_MKT} SELECT *, TG_KEY || '-' || MARKET_KEY AS cell_key FROM ref_tg_mkt",
    "cells_of_source": f"WITH {o.REF_TG_MKT} SELECT * FROM ref_tg_mkt WHERE SOURCE = 'CUST_SALES/BARC'",
    "name_to_keys": o.query(
        [_CLIENTS, _CHOSEN],
        "SELECT name, CAST(coalesce(key, -1) AS INTEGER) AS key FROM chosen LEFT JOIN clients USING (name)",
    ),
    "cell_name_to_keys": f"""WITH {o.REF_CHANNEL}, {o.REF_TG_MKT},
      chosen AS (SELECT TG_MARKET_DISPLAY_NAME AS name FROM ref_channel
        UNION SELECT TG_MARKET_DISPLAY_NAME || '?' FROM ref_channel)
      SELECT name, CAST(coalesce(TG_KEY, -1) AS INTEGER) AS TG_KEY, CAST(coalesce(MARKET_KEY, -1) AS INTEGER) AS MARKET_KEY
      FROM chosen LEFT JOIN ref_tg_mkt ON TG_MARKET_DISPLAY_NAME = name""",
    "validate_params": o.query(
        [_CLIENTS, _CHOSEN],
        "SELECT 'client' AS parameter, name FROM chosen WHERE name NOT IN (SELECT name FROM clients)",
    ),
    "network_colors_csv": """SELECT lower(n_name) AS Network,
        '#' || lower(lpad(printf('%X', n_nationkey * 104729 + 255), 6, '0')) AS HexCode
      FROM nation WHERE n_nationkey < 20 UNION ALL SELECT 'others', '#ffffff'""",
    "reference_cells_csv": f"""WITH {o.REF_CHANNEL}
      SELECT DISTINCT TG_MARKET_DISPLAY_NAME, TG_KEY, MARKET_KEY FROM ref_channel WHERE TG_DISPLAY_NAME LIKE 'TG 1%'""",
    "search_terms_csv": "SELECT n_name AS term FROM nation",
    "news_csv_append": o.query([_NEWS], f"SELECT {_NEWS_OUT} FROM news UNION ALL SELECT {_NEWS_OUT} FROM news"),
    "reportee_closure": o.query(
        _HIERARCHY,
        "SELECT DISTINCT manager_name AS manager, CAST(key AS VARCHAR) AS EMPLOYEE_KEY FROM closure",
        recursive=True,
    ),
    "channel_closure": o.query(
        _HIERARCHY,
        """SELECT manager_name AS manager, channel AS CHANNEL_GROUP_KEY FROM closure JOIN access USING (key)
          UNION SELECT upper(name), channel FROM access JOIN staff USING (key)""",
        recursive=True,
    ),
    "channel_lists": o.query(
        _HIERARCHY,
        _key_lists(
            """SELECT manager_name AS name, channel AS key FROM closure JOIN access USING (key)
              UNION SELECT upper(name), channel FROM access JOIN staff USING (key)""",
            most=6,
        ),
        recursive=True,
    ),
    "row_scope": o.query([*_HIERARCHY, _SCOPE], "SELECT * FROM scopes", recursive=True),
    "row_scope_reportees": o.query(
        _HIERARCHY,
        """SELECT 'U' || key AS EMPLOYEE_NT_ID, 'all' AS scope, NULL::VARCHAR AS EMPLOYEE_KEY FROM staff
          WHERE role = 'HO GROUP' UNION SELECT 'U' || manager, 'listed', CAST(key AS VARCHAR) FROM closure""",
        recursive=True,
    ),
    "rows_in_scope": o.query(
        [*_HIERARCHY, _SCOPE],
        f"""SELECT {_ACCESS_OUT}, 'U1' AS user FROM access WHERE channel_name <> 'ALL' AND CAST(key AS VARCHAR) IN
            (SELECT EMPLOYEE_KEY FROM scopes WHERE EMPLOYEE_NT_ID = 'U1')
          UNION ALL SELECT {_ACCESS_OUT}, 'U0' FROM access WHERE channel_name <> 'ALL'""",
        recursive=True,
    ),
    "scope_key_texts": o.query(
        _HIERARCHY,
        _key_lists(
            """SELECT 'employees' AS name, CAST(a.key AS VARCHAR) AS key FROM access a JOIN closure c ON c.key = a.key AND c.manager = 1
              UNION SELECT 'locations', location FROM access a JOIN closure c ON c.key = a.key AND c.manager = 1"""
        ),
        recursive=True,
    ),
    "channel_key_texts": o.query(
        [_ACCESS],
        _key_lists("SELECT DISTINCT channel_name AS name, channel AS key FROM access WHERE channel_name <> 'ALL'"),
    ),
    "may_see_all": o.query(
        [_STAFF, _ACCESS],
        """SELECT 'U' || key AS EMPLOYEE_NT_ID, CAST(key AS VARCHAR) AS EMPLOYEE_KEY FROM staff
          WHERE role = 'HO GROUP' AND key IN (SELECT key FROM access WHERE channel_name = 'ALL')""",
    ),
    "employee_roles": o.query(
        [_STAFF],
        """SELECT 'U' || key AS EMPLOYEE_NT_ID, CAST(key AS VARCHAR) AS EMPLOYEE_KEY, role AS EMPLOYEE_ROLE,
          CASE WHEN second_role IS NULL OR second_role LIKE '-%' THEN 'NONE' ELSE second_role END AS SECONDARY_ROLE
          FROM staff""",
    ),
    "entitlement_matrix": o.query([_STAFF, _DASHBOARDS], _ENTITLED),
    "entitlement_removal": o.query(
        [_STAFF, _DASHBOARDS], _ENTITLED + " AND NOT (role = 'SALES EXECUTIVE' AND dashboard = 'region_0')"
    ),
    "news_parse": o.query([_NEWS, _PARSED], f"SELECT {_NEWS_OUT}, feed_no, position FROM parsed"),
    "news_top10": o.query(
        [_NEWS, _PARSED], f"SELECT {_NEWS_OUT}, feed_no, position FROM parsed WHERE position < 10"
    ),
    "news_distinct": o.query([_NEWS], f"SELECT DISTINCT {_NEWS_OUT} FROM news"),
    "news_archive_dedupe": o.query([_NEWS], f"SELECT DISTINCT {_NEWS_OUT} FROM news"),
    "news_visible": o.query(
        [_NEWS],
        f"""SELECT {_NEWS_OUT} FROM news WHERE news.PublishDate > {_NOW} - INTERVAL 3 DAY
          AND lower(Source) NOT IN ('www.example.com', 'ththre.example.com', 'm.ththth.example.net')""",
    ),
    "news_fresh_counts": o.query(
        [_NEWS],
        f"""SELECT SearchTerm, count(*) FILTER (WHERE PublishDate > {_NOW} - INTERVAL 3 DAY) AS fresh_items
          FROM news GROUP BY 1""",
    ),
    "news_terms_to_fetch": o.query(
        [_NEWS, _TERMS],
        f"""SELECT DISTINCT lower(term) AS term FROM terms WHERE lower(term) NOT IN
          (SELECT lower(SearchTerm) FROM news WHERE PublishDate > {_NOW} - INTERVAL 14 DAY)""",
    ),
    "news_ticker": o.query(
        [_NEWS, _TERMS],
        f"""SELECT term, CASE WHEN Link IS NULL THEN 'No Data Available'
            ELSE '<a target = "blank" class="tab" href="' || Link || '">' || Title || '</a>' END AS anchor
          FROM terms LEFT JOIN (SELECT * FROM news WHERE PublishDate > {_NOW} - INTERVAL 175 DAY) n
            ON n.SearchTerm = term
          WHERE coalesce(lower(Source) <> 'm.ththth.example.net', true)""",
    ),
    "news_ticker_mapped": o.query(
        [_NEWS],
        f"""SELECT upper(SearchTerm) || '''s & Co' AS term, SearchTerm AS search_term,
            '<a target = "blank" class="tab" href="' || Link || '">' || Title || '</a>' AS anchor
          FROM news WHERE SearchTerm <> '' AND PublishDate > {_NOW} - INTERVAL 175 DAY
            AND lower(Source) NOT IN ('moneycontrol.com', 'indiainfoline')
          UNION ALL SELECT upper(n_name[1]) || lower(n_name[2:]), lower(n_name), 'No Data Available' FROM nation""",
    ),
    "term_mapping": """WITH chosen AS (SELECT DISTINCT p_name, p_type FROM part),
      sizes AS (SELECT p_name, min(p_size) AS size FROM part GROUP BY 1)
      SELECT upper(p_name) || '''s & "Co"/' || p_type AS term,
        CASE WHEN p_type = 'ECONOMY' THEN p_name || ' ' || size
          ELSE replace(lower(p_name), ' ', '%20') || 's%20%26%20co/' || lower(p_type) END AS search_term
      FROM chosen JOIN sizes USING (p_name)""",
    "news_fields": o.query(
        [_NEWS],
        r"""SELECT page_id, replace(Title, ' ', '') AS compact,
          regexp_replace(Title, '[^\x00-\x7F]', '', 'g') AS ascii,
          regexp_replace(Title, '[^A-Za-z0-9_]+', '', 'g') AS slug, replace(Title, '&', 'and') AS spelled FROM news""",
    ),
    "news_stream_archive": o.query(
        [_NEWS], f"SELECT DISTINCT trim(Title) AS Title, {_NEWS_TEXT}, Link, Source, SearchTerm FROM news"
    ),
}

ORACLES["published_newest_week"] = ORACLES["default_end_date"]
ORACLES["news_stream_repeats"] = f"""SELECT day, count(*) AS archived, count(*) AS tested FROM (
  SELECT DISTINCT CAST(PublishDate AS DATE) AS day, Title, PublishDate, Link, Source, SearchTerm
  FROM ({o.query([_NEWS], f"SELECT DISTINCT trim(Title) AS Title, {_NEWS_TEXT}, Link, Source, SearchTerm FROM news")})
) GROUP BY day"""
ORACLES["latest_dates_from_footers"] = ORACLES["latest_dates"]
ORACLES["checked_reference_csv"] = f"""WITH {o.REF_CHANNEL.strip()}
  SELECT CHANNEL_GROUP_KEY || ',' || TG_KEY || ',' || MARKET_KEY AS record, 'none' AS reason FROM ref_channel
  UNION ALL SELECT regexp_replace(n_name, '[^A-Za-z]', '_', 'g') || ',three,fields', 'does not fit the schema' FROM nation
  UNION ALL SELECT s_suppkey || ',c,one,1,S,a,b,ab', 'does not fit the schema' FROM supplier WHERE s_suppkey % 3 = 0
  UNION ALL SELECT ',' || s_suppkey || ',1,1,S,a,b,ab', 'CHANNEL_GROUP_KEY is missing' FROM supplier WHERE s_suppkey % 3 = 1"""
ORACLES["checked_feeds"] = """SELECT page_id AS feed_no,
    CASE WHEN page_id % 11 = 0 THEN 'not XML' WHEN page_id % 7 = 0 THEN 'no items'
      WHEN page_id % 5 = 0 THEN 'date not readable' WHEN page_id % 5 = 1 THEN 'link without target' ELSE 'none' END AS reason,
    CASE WHEN page_id % 11 <> 0 AND page_id % 7 <> 0 THEN 0 END::INTEGER AS position
  FROM pages"""
