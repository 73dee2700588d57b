"""DuckDB SQL of the roll-up, affinity, insight and display queries."""

from __future__ import annotations

from reachlens.plans import oracle_base as o

_PROGRAM = [o.FACT, o.program()]
_GENRE_CHANNEL = [*_PROGRAM, o.genre_channel()]
_SHOW = [o.FACT, o.show()]

_AFFINITY = """SELECT category, level, cat_key, level_key, CAST(prog_metric AS DOUBLE) AS prog_metric,
  CAST(metric_share AS DOUBLE) AS metric_share, CAST(client_metric AS DOUBLE) AS client_metric,
  CAST(client_share AS DOUBLE) AS client_share, genre, ntwk FROM affinity"""
_ENRICHED = """SELECT category, level, prog_metric, round(genre_share, 6) AS genre_share,
  round(affinity, 6) AS affinity, client_metric, round(client_genre_share, 6) AS client_genre_share,
  round(overall_share, 6) AS overall_share, genre, ntwk FROM enriched"""


def _sums(table: str) -> str:
    return f"SELECT * EXCLUDE (ADGRP, FCT, TVT), {o.SUMS_OUT} FROM {table}"


_HOME = "home AS (SELECT 'NATION_7' AS name)"
_CHANNELS = [*_GENRE_CHANNEL, *o.channel_enriched_ctes()]
_INSIGHT_ROWS = "SELECT category, level, round(overall_share, 6) AS overall_share, round(affinity, 6) AS affinity"
_NAMED_CELLS = """named_cells AS (
  SELECT *, 'TG ' || TG_KEY AS TG_DISPLAY_NAME, 'MKT ' || MARKET_KEY AS MARKET_DISPLAY_NAME FROM fact
)"""
_EXPLORE = """ FROM named_cells WHERE TG_DISPLAY_NAME = 'TG 1' AND MARKET_DISPLAY_NAME = 'MKT 1'
  AND BARC_WEEK >= 0 AND CALENDAR_YEAR >= 1997 GROUP BY ALL"""
_VALUES = ["prog_metric", "genre_share", "affinity", "client_metric", "client_genre_share", "overall_share"]
_ROUNDED_VALUES = ", ".join(f"round({value}, 6) AS {value}" for value in _VALUES)


def _club(rows: str = "enriched") -> list[str]:
    """Bucketed networks as CTE ``club``."""
    means = ", ".join(f"avg({value}) AS {value}" for value in _VALUES)
    return [
        f"""
top4 AS (
  SELECT lower(ntwk) AS ntwk, sum(client_metric) AS client_metric FROM {rows}
  WHERE lower(ntwk) <> 'others' AND client_metric IS NOT NULL GROUP BY lower(ntwk)
  ORDER BY client_metric DESC, ntwk LIMIT 4
),
club AS (
  SELECT * FROM (
    SELECT category, level, genre,
      CASE WHEN lower(ntwk) IN (SELECT ntwk FROM top4) THEN lower(ntwk) ELSE 'Others' END AS ntwk, {means}
    FROM {rows} GROUP BY ALL
  ) WHERE client_metric IS NOT NULL
)"""
    ]


_TOP100 = """top100 AS (
  SELECT * FROM enriched ORDER BY client_metric DESC NULLS LAST, category, level, genre, ntwk LIMIT 100
)"""


def _unit(value: str) -> str:
    value = f"CAST({value} AS DOUBLE)"
    cases = " ".join(
        f"WHEN {value} >= {size} THEN format('{{:,.1f}}', round({value} / {size}, 1)) || '{unit}'"
        for size, unit in (("1e12", "lk cr"), ("1e7", "cr"), ("1e5", "lk"), ("1e3", "k"))
    )
    return f"CASE {cases} ELSE format('{{:,.1f}}', round({value}, 1)) END"


def _number(value: str, decimals: int) -> str:
    return f"format('{{:,.{decimals}f}}', round({value}, {decimals}))"


def _cell(name: str, raw: str, text: str) -> str:
    return (
        f"CASE WHEN {name} IS NULL THEN '0' ELSE {raw} END AS {name}_raw,"
        f" CASE WHEN {name} IS NULL THEN 'NA' ELSE {text} END AS {name}_text"
    )


def _short(text: str) -> str:
    return f"CASE WHEN length({text}) >= 11 THEN substr({text}, 1, 10) || '..' ELSE {text} END"


_BEFORE_NETWORK = "trim(split_part(level, 'Network', 1))"
_CELLS = ", ".join(
    [
        f"category AS category_raw, {_short('category')} AS category_text",
        f"level AS level_raw, {_short(_BEFORE_NETWORK)} AS level_text",
        _cell("prog_metric", _number("prog_metric", 0), _unit("prog_metric")),
        _cell("genre_share", _number("genre_share", 2), _number("genre_share", 0)),
        _cell("affinity", _number("affinity", 2), _number("affinity", 0) + " || '%'"),
        _cell("client_metric", _number("client_metric", 0), _unit("client_metric")),
        _cell("client_genre_share", _number("client_genre_share", 2), _number("client_genre_share", 0)),
        _cell("overall_share", _number("overall_share", 2), _number("overall_share", 0)),
        *[
            f"round({name} / (SELECT max({name}) FROM club), 6) AS {name}_bar"
            for name in ("genre_share", "client_genre_share", "overall_share")
        ],
        "regexp_replace(category, '[^A-Za-z0-9_]+', '', 'g') || '-' ||"
        " regexp_replace(level, '[^A-Za-z0-9_]+', '', 'g') AS row_slug",
        "category || ' ' || level || ' ' || genre || ' ' || ntwk AS search",
    ]
)

_EXTENTS = """
ends AS (
  SELECT min(affinity) AS x_min, max(affinity) AS x_max, min(prog_metric) AS y_min, max(prog_metric) AS y_max,
    min(coalesce(prog_metric, 0)) AS y_min0, max(client_metric) AS bubble_max FROM club
)"""
_EXTENTS_OUT = """SELECT floor(x_min) AS x_lo, ceil(x_max) AS x_hi, floor(y_min) AS y_lo, ceil(y_max) AS y_hi,
  round(x_min - (x_max - x_min) * 8 / 100 - CASE WHEN x_min = x_max THEN 1 ELSE 0 END, 6) AS chart_x_lo,
  round(x_max + (x_max - x_min) * 8 / 100 + CASE WHEN x_min = x_max THEN 1 ELSE 0 END, 6) AS chart_x_hi,
  round(y_min * 0.9::DOUBLE, 6) AS chart_y_lo,
  round(CASE WHEN y_min = y_max THEN y_min + 1 ELSE y_max END * 1.09::DOUBLE, 6) AS chart_y_hi,
  round((y_min0 + y_max) / 2, 6) AS y_mid, round(bubble_max, 6) AS bubble_max FROM ends"""


def _insight_list(level: str) -> str:
    """The five insights of one level over CTEs ``enriched`` (and ``channels`` at the genre level)."""
    title = level.title()
    rows, rows_title = ("channels", "Channel") if level == "genre" else ("enriched", title)
    home = "(SELECT name FROM home)"
    is_home = f"coalesce(ntwk = {home}, false)"
    used = "client_metric IS NOT NULL"
    none = "NULL::VARCHAR AS category, NULL::VARCHAR AS level, NULL::DOUBLE AS overall_share, NULL::DOUBLE AS affinity"

    def table(number: int, text: str, source: str, where: str, order: str) -> str:
        return f"""SELECT {number} AS insight, {text} AS statement,
          CAST(row_number() OVER (ORDER BY {order}, category, level) AS INTEGER) AS position, category, level,
          round(overall_share, 6) AS overall_share, round(affinity, 6) AS affinity
        FROM (SELECT * FROM {source} WHERE {where} ORDER BY {order}, category, level LIMIT 3)"""

    market, client = (
        f"coalesce(sum({m}) FILTER (WHERE {is_home}) / nullif(sum({m}), 0) * 100, 0)"
        for m in ("prog_metric", "client_metric")
    )
    return " UNION ALL ".join(
        [
            f"""SELECT 1 AS insight, {home} || ' market share is ' || format('{{:.2f}}', round({market}, 2))
              || '% of Total AD GRPs while client spends ' || format('{{:.2f}}', round({client}, 2)) || '% on '
              || {home} AS statement, 0 AS position, {none} FROM enriched""",
            table(
                2,
                f"'High Spend by client on low ROI competitive {title}: Spend > [5] %, and TG-Affinity < [50].'",
                "enriched",
                f"{used} AND NOT {is_home} AND overall_share > 5 AND affinity < 50",
                "overall_share DESC",
            ),
            table(
                3,
                f"'Low Spend by client on high ROI ' || {home} || ' {title}: Spend < [5] %, and TG-Affinity > [80].'",
                "enriched",
                f"{used} AND {is_home} AND overall_share < 5 AND affinity > 80",
                "overall_share",
            ),
            f"""SELECT 4, 'No of {rows_title} on ' || {home} || ' with TG-Affinity >= 100 : ' ||
              count(*) FILTER (WHERE {is_home} AND {used} AND affinity >= 100), 0, {none} FROM {rows}""",
            table(
                5,
                f"'Top 3 (by Client AD GRP) client spend on {rows_title} on Competition with Affinity < 100'",
                rows,
                f"{used} AND NOT {is_home} AND affinity < 100",
                "client_metric DESC",
            ),
        ]
    )


def _insight_query(level: str) -> str:
    ctes = o.enriched_ctes(level)
    if level == "genre":
        ctes = [*ctes, *o.channel_enriched_ctes()]
    return o.query([*ctes, _HOME], f"SELECT * FROM ({_insight_list(level)})")


_UPPER_NAME = f"""
pairs AS (
  SELECT a.category, a.level, a.cat_key, a.level_key,
    coalesce(t.TG_KEY, 0) AS older_tg, coalesce(t.MARKET_KEY, 0) AS older_market,
    coalesce(b.TG_KEY, 0) AS newer_tg, coalesce(b.MARKET_KEY, 0) AS newer_market
  FROM affinity a
  LEFT JOIN ref_genre t ON upper(a.category) = upper(t.GENRE_NAME) AND t.SOURCE = 'CUST_SALES'
  LEFT JOIN ref_genre b ON upper(a.category) = upper(b.GENRE_NAME) AND b.SOURCE = 'CUST_SALES/BARC'
  WHERE a.client_metric IS NOT NULL
)"""
_UPPER_NAME_OUT = f"""SELECT category, level, cat_key, level_key, CAST((
    SELECT sum({o.METRIC}) FROM genre_channel g
    WHERE (TG_KEY, MARKET_KEY) IN ((older_tg, older_market), (newer_tg, newer_market))
      AND (GENRE_KEY, NETWORK_KEY) = (cat_key, level_key) AND {o.WEEKS}
  ) AS DOUBLE) AS affinity_denom FROM pairs"""

ORACLES: dict[str, str] = {
    "prog_rollup": o.query(_PROGRAM, _sums("program")),
    "genre_channel_rollup": o.query(_GENRE_CHANNEL, _sums("genre_channel")),
    "show_rollup": o.query(_SHOW, _sums("show_prog")),
    "show_affinity_base": o.query([*_SHOW, o.REF_CHANNEL, o.SHOW_BASE], _sums("show_base")),
    "channel_affinity_base": o.query([*_GENRE_CHANNEL, o.REF_CHANNEL, o.CHANNEL_BASE], _sums("channel_base")),
    "genre_affinity_base": o.query([*_GENRE_CHANNEL, o.REF_GENRE, o.GENRE_BASE], _sums("genre_base")),
    "affinity_genre": o.query(o.level_ctes("genre"), _AFFINITY),
    "affinity_genre_fct": o.query(o.level_ctes("genre", metric="FCT"), _AFFINITY),
    "affinity_genre_tvt": o.query(o.level_ctes("genre", metric="TVT"), _AFFINITY),
    "affinity_channel": o.query(o.level_ctes("channel"), _AFFINITY),
    "affinity_show": o.query(o.level_ctes("show"), _AFFINITY),
    "enriched_genre": o.query(o.enriched_ctes("genre"), _ENRICHED),
    "enriched_genre_from_tables": o.query(o.enriched_ctes("genre"), _ENRICHED),
    "enriched_channel": o.query(o.enriched_ctes("channel"), _ENRICHED),
    "enriched_channel_from_tables": o.query(o.enriched_ctes("channel"), _ENRICHED),
    "enriched_show_from_tables": o.query(
        [*o.enriched_ctes("show"), _TOP100], _ENRICHED.replace("FROM enriched", "FROM top100")
    ),
    "enriched_show_top100": o.query([*o.enriched_ctes("show"), _TOP100], _ENRICHED.replace("FROM enriched", "FROM top100")),
    "enriched_show_by_total": o.query(
        o.enriched_ctes("show"),
        _ENRICHED + " WHERE client_metric IS NOT NULL ORDER BY enriched.prog_metric DESC, category, level, genre, ntwk LIMIT 100",
    ),
    "affinity_same_cell_twice": o.query(o.level_ctes("genre", o.OLDER, o.OLDER), _AFFINITY),
    "channel_insights": o.query(
        [*_GENRE_CHANNEL, o.channel_enriched_ctes()[0]],
        "SELECT * REPLACE (CAST(client_metric AS DOUBLE) AS client_metric, CAST(prog_metric AS DOUBLE) AS prog_metric)"
        " FROM chnl",
    ),
    "channel_insights_enriched": o.query(
        _CHANNELS,
        "SELECT * REPLACE (round(overall_share, 6) AS overall_share, round(affinity, 6) AS affinity) FROM channels",
    ),
    "base_by_upper_name": o.query([*o.level_ctes("genre"), o.REF_GENRE, _UPPER_NAME], _UPPER_NAME_OUT),
    "exploration_all": o.query(
        [o.FACT, _NAMED_CELLS],
        "SELECT GENRE_DISPLAY_NAME, NETWORK_DISPLAY_NAME, CAST(sum(ADGRP) AS DOUBLE) AS prog_metric" + _EXPLORE,
    ),
    "exploration_per_advertiser": o.query(
        [o.FACT, _NAMED_CELLS],
        "SELECT ADVERTISERS_GROUP_DISPLAY_NAME, GENRE_DISPLAY_NAME, NETWORK_DISPLAY_NAME,"
        " CAST(sum(ADGRP) AS DOUBLE) AS prog_metric" + _EXPLORE,
    ),
    "insight_home_share": o.query(
        [*o.enriched_ctes("genre"), _HOME],
        """SELECT round(coalesce(sum(prog_metric) FILTER (WHERE ntwk = home.name) / sum(prog_metric) * 100, 0), 6)
          AS market_share,
          round(coalesce(sum(client_metric) FILTER (WHERE ntwk = home.name) / nullif(sum(client_metric), 0) * 100, 0), 6)
          AS client_share FROM enriched, home""",
    ),
    "insight_high_spend_low_affinity": o.query(
        [*o.enriched_ctes("genre"), _HOME],
        f"{_INSIGHT_ROWS} FROM enriched, home WHERE client_metric IS NOT NULL AND ntwk <> home.name"
        " AND enriched.overall_share > 3 AND enriched.affinity < 80"
        " ORDER BY enriched.overall_share DESC, category, level LIMIT 3",
    ),
    "insight_low_spend_high_affinity": o.query(
        [*o.enriched_ctes("channel"), _HOME],
        f"{_INSIGHT_ROWS} FROM enriched, home WHERE client_metric IS NOT NULL AND ntwk = home.name"
        " AND enriched.overall_share < 5 AND enriched.affinity > 80"
        " ORDER BY enriched.overall_share, category, level LIMIT 3",
    ),
    "insight_affinity_count": o.query(
        [*_CHANNELS, _HOME],
        "SELECT count(*) AS n FROM channels, home"
        " WHERE ntwk = home.name AND client_metric IS NOT NULL AND affinity >= 100",
    ),
    "insight_top_competitor": o.query(
        [*_CHANNELS, _HOME],
        f"{_INSIGHT_ROWS} FROM channels, home WHERE client_metric IS NOT NULL AND ntwk <> home.name"
        " AND channels.affinity < 100 ORDER BY client_metric DESC, category, level LIMIT 3",
    ),
    "insight_list_genre": _insight_query("genre"),
    "insight_list_channel": _insight_query("channel"),
    "insight_list_show": _insight_query("show"),
    "top_networks": o.query([*o.enriched_ctes("channel"), *_club()], "SELECT * FROM top4"),
    "club_others": o.query(
        [*o.enriched_ctes("channel"), *_club()], f"SELECT category, level, genre, ntwk, {_ROUNDED_VALUES} FROM club"
    ),
    "club_others_show": o.query(
        [*o.enriched_ctes("show"), _TOP100, *_club("top100")],
        f"SELECT category, level, genre, ntwk, {_ROUNDED_VALUES} FROM club",
    ),
    "axis_extents": o.query([*o.enriched_ctes("channel"), *_club(), _EXTENTS], _EXTENTS_OUT),
    "axis_range_filter": o.query(
        [*o.enriched_ctes("channel"), *_club(), _EXTENTS],
        f"""SELECT category, level, genre, ntwk, {_ROUNDED_VALUES} FROM club, ends
          WHERE club.affinity >= 50 AND club.affinity <= ceil(x_max) AND club.prog_metric >= floor(y_min)
          AND club.prog_metric <= 901""",
    ),
    "axis_range_default": o.query(
        [*o.enriched_ctes("channel"), *_club()],
        f"SELECT category, level, genre, ntwk, {_ROUNDED_VALUES} FROM club WHERE club.affinity IS NOT NULL",
    ),
    "unit_format": o.query(
        [
            o.FACT,
            "spend AS (SELECT ADVERTISERS_GROUP_KEY, CAST(sum(FCT) AS DOUBLE) AS f, CAST(sum(ADGRP) AS DOUBLE) AS a"
            " FROM fact GROUP BY ALL)",
        ],
        f"""SELECT ADVERTISERS_GROUP_KEY, {_unit("(f * 100000)")} AS huge, {_unit("f")} AS fct, {_unit("a")} AS adgrp,
          {_unit("(a / 100)")} AS hundredth, {_unit("(a / 1e6)")} AS tiny FROM spend""",
    ),
    "cell_format": o.query([*o.enriched_ctes("genre"), *_club()], f"SELECT {_CELLS} FROM club"),
    "bubbles": o.query(
        [*o.enriched_ctes("channel"), *_club()],
        """SELECT category, level, club.ntwk, round(coalesce(affinity, 0), 6) AS x,
          round(coalesce(prog_metric, 0), 6) AS y,
          round(coalesce(club.client_metric / (SELECT max(client_metric) FROM club) * 10, 0), 6) AS radius,
          coalesce('#' || lower(lpad(printf('%X', n_nationkey * 104729 + 255), 6, '0')), '#ffffff') AS color,
          regexp_replace(category, '[^A-Za-z0-9_]+', '', 'g') || '-' ||
          regexp_replace(level, '[^A-Za-z0-9_]+', '', 'g') AS row_slug,
          CASE WHEN club.ntwk = 'Others' THEN 'Others' ELSE 'N' || substr(club.ntwk, 2) END AS network_slug
        FROM club LEFT JOIN nation ON lower(n_name) = club.ntwk AND n_nationkey < 20""",
    ),
    "search_filter": o.query(
        [*o.enriched_ctes("channel"), *_club()],
        """SELECT category, level, genre, ntwk FROM club
          WHERE regexp_matches(category || ' ' || level || ' ' || genre || ' ' || ntwk, 'economy|nation_1[0-5]', 'i')""",
    ),
    "pick_list_search": """SELECT s_suppkey AS CHANNEL_GROUP_KEY, s_name AS CHANNEL_GROUP_DISPLAY_NAME
      FROM supplier WHERE contains(lower(s_name), 'supplier#0000000')""",
    "base_market_pivot": f"""WITH {o.REF_CHANNEL},
      m AS (
        SELECT CHANNEL_GROUP_DISPLAY_NAME AS name,
          coalesce(max(TG_MARKET_DISPLAY_NAME) FILTER (WHERE SOURCE = 'CUST_SALES'), '') AS tam,
          coalesce(max(TG_MARKET_DISPLAY_NAME) FILTER (WHERE SOURCE = 'CUST_SALES/BARC'), '') AS barc
        FROM ref_channel GROUP BY 1
      ) SELECT *, tam AS shown_before, barc AS shown_after FROM m""",
    "base_market_pivot_genre": f"""WITH {o.GENRES}, {o.REF_GENRE}
      SELECT GENRE_DISPLAY_NAME AS name,
        coalesce(max(TG_MARKET_DISPLAY_NAME) FILTER (WHERE SOURCE = 'CUST_SALES'), '') AS tam,
        coalesce(max(TG_MARKET_DISPLAY_NAME) FILTER (WHERE SOURCE = 'CUST_SALES/BARC'), '') AS barc
      FROM ref_genre GROUP BY 1""",
    "download_export_selection": o.query(
        o.enriched_ctes("channel"),
        """SELECT 0::INTEGER AS block, 0::INTEGER AS line, 'Client' AS c0, n_name AS c1, NULL::VARCHAR AS c2,
            NULL::VARCHAR AS c3, NULL::VARCHAR AS c4, NULL::VARCHAR AS c5, NULL::VARCHAR AS c6, NULL::VARCHAR AS c7
          FROM nation WHERE n_nationkey = 3
          UNION ALL SELECT * FROM (VALUES (0, 1, 'Metric', 'ADGRP', NULL, NULL, NULL, NULL, NULL, NULL),
            (0, 2, 'Period', '199601 - 199652', NULL, NULL, NULL, NULL, NULL, NULL),
            (0, 3, 'Level', 'Channel', NULL, NULL, NULL, NULL, NULL, NULL),
            (1, 0, 'Channel', 'Genre', 'Total AD GRP', 'Genre Share', 'Affinity', 'Client AD GRP',
              'Client Genre Share', 'Overall Share'))
          UNION ALL SELECT 2, NULL, category, level, round(prog_metric, 2)::DECIMAL(20,2)::VARCHAR,
            round(genre_share, 2)::DECIMAL(20,2)::VARCHAR, round(affinity, 2)::DECIMAL(20,2)::VARCHAR,
            round(client_metric, 2)::DECIMAL(20,2)::VARCHAR, round(client_genre_share, 2)::DECIMAL(20,2)::VARCHAR,
            round(overall_share, 2)::DECIMAL(20,2)::VARCHAR FROM enriched""",
    ),
    "download_export": o.query(
        o.enriched_ctes("channel"),
        """SELECT category AS "Channel", level AS "Genre", round(prog_metric, 2) AS "Total AD GRP",
          round(genre_share, 2) AS "Genre Share", round(affinity, 2) AS "Affinity",
          round(client_metric, 2) AS "Client AD GRP", round(client_genre_share, 2) AS "Client Genre Share",
          round(overall_share, 2) AS "Overall Share" FROM enriched""",
    ),
}
