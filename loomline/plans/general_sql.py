"""DuckDB SQL of the queries in general.py, written from the problem statements."""

from __future__ import annotations

#: One row for each readable snapshot: entity, date, load order and five bare attribute values.
_SNAPSHOTS = r"""
raw AS (
  SELECT id AS seq, as_of_date, loaded_at, payload FROM instrument_ref_json
  WHERE as_of_date IS NOT NULL AND json_valid(payload) AND json_type(payload) = 'OBJECT'),
lv1 AS (
  SELECT seq, as_of_date, loaded_at, lower(regexp_replace(e.key, '[\s\xa0_\-]+', '', 'g')) AS k, e.value AS v, e.type AS ty, e.id AS pos
  FROM raw, json_each(payload) e),
lv2 AS (
  SELECT seq, as_of_date, loaded_at, lower(regexp_replace(e.key, '[\s\xa0_\-]+', '', 'g')) AS k, e.value AS v, e.type AS ty, 1000000 + pos * 1000 + e.id AS pos
  FROM (SELECT seq, as_of_date, loaded_at, pos, v FROM lv1 WHERE ty = 'OBJECT') l, json_each(l.v) e),
pairs AS (
  SELECT seq, as_of_date, loaded_at, k, pos, CASE WHEN ty = 'VARCHAR' THEN v ->> '$' ELSE CAST(v AS VARCHAR) END AS v
  FROM (SELECT * FROM lv1 UNION ALL SELECT * FROM lv2) WHERE ty <> 'NULL'),
full_pairs AS (
  SELECT seq, as_of_date, loaded_at, k, min_by(v, pos) AS v FROM pairs
  WHERE trim(regexp_replace(v, '[\s\xa0]+', ' ', 'g')) <> '' GROUP BY ALL),
snap AS (
  SELECT seq, as_of_date, loaded_at,
    upper(regexp_replace(max(v) FILTER (WHERE k = 'isin'), '[\s\xa0]+', '', 'g')) AS isin,
    lower(regexp_replace(max(v) FILTER (WHERE k = 'ticker'), '[\s\xa0_\-]+', '', 'g')) AS ticker,
    lower(regexp_replace(max(v) FILTER (WHERE k = 'assetclass'), '[\s\xa0_\-]+', '', 'g')) AS asset_class,
    lower(regexp_replace(max(v) FILTER (WHERE k = 'region'), '[\s\xa0_\-]+', '', 'g')) AS region,
    lower(regexp_replace(max(v) FILTER (WHERE k = 'sector'), '[\s\xa0_\-]+', '', 'g')) AS sector,
    lower(regexp_replace(max(v) FILTER (WHERE k = 'currency'), '[\s\xa0_\-]+', '', 'g')) AS currency
  FROM full_pairs GROUP BY ALL HAVING isin <> ''),
last_of_day AS (
  SELECT * FROM snap QUALIFY row_number() OVER (PARTITION BY isin, as_of_date ORDER BY loaded_at DESC, seq DESC) = 1),
filled AS (
  SELECT isin, as_of_date,
    last_value(ticker IGNORE NULLS) OVER w AS ticker, last_value(asset_class IGNORE NULLS) OVER w AS asset_class,
    last_value(region IGNORE NULLS) OVER w AS region, last_value(sector IGNORE NULLS) OVER w AS sector,
    last_value(currency IGNORE NULLS) OVER w AS currency
  FROM last_of_day WINDOW w AS (PARTITION BY isin ORDER BY as_of_date ROWS UNBOUNDED PRECEDING)),
marked AS (
  SELECT *, lag(ROW(ticker, asset_class, region, sector, currency)) OVER w AS before, row_number() OVER w AS rn
  FROM filled WINDOW w AS (PARTITION BY isin ORDER BY as_of_date)),
versions AS (
  SELECT isin, as_of_date AS valid_from, lead(as_of_date) OVER (PARTITION BY isin ORDER BY as_of_date) AS valid_to, ticker, asset_class, region, sector, currency
  FROM marked WHERE rn = 1 OR before IS DISTINCT FROM ROW(ticker, asset_class, region, sector, currency))
"""

_KEY = r"regexp_replace(lower({0}), '^[^\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+$', '', 'g')".format

_ORPHANS = f"""
refs AS (
  SELECT 'files' AS src_table, 'run_id' AS src_field, id AS row_id, 'runs' AS target, run_id AS ref, created_at FROM files
  UNION ALL SELECT 'files', 'repository_id', id, 'repositories', repository_id, created_at FROM files
  UNION ALL SELECT 'repositories', 'project_id', id, 'projects', project_id, created_at FROM repositories
  UNION ALL SELECT 'runs', 'project_id', id, 'projects', project_id, created_at FROM runs),
good AS (SELECT DISTINCT *, {_KEY('ref')} AS key FROM refs WHERE regexp_replace(ref, '[\\s\\xa0]+', '', 'g') <> ''),
known AS (
  SELECT target, key, min(created_at) AS since FROM (
    SELECT 'runs' AS target, {_KEY('id')} AS key, created_at FROM runs
    UNION ALL SELECT 'repositories', {_KEY('id')}, created_at FROM repositories
    UNION ALL SELECT 'projects', {_KEY('id')}, created_at FROM projects) GROUP BY ALL),
gone AS (SELECT DISTINCT lower(trim(table_name)) AS target, {_KEY('record_id')} AS key FROM deleted_records),
judged AS (
  SELECT src_table, src_field, row_id, strftime(created_at, '%Y-%m') AS period,
    CASE WHEN k.key IS NOT NULL THEN CASE WHEN created_at < since THEN 'late' END WHEN d.key IS NOT NULL THEN 'deleted' ELSE 'missing' END AS state
  FROM good g LEFT JOIN known k USING (target, key) LEFT JOIN gone d USING (target, key)),
orphans AS (SELECT DISTINCT * FROM judged WHERE state IS NOT NULL)
"""

#: Currency of a text of trade_feed_venue_a, hundredths included.
_CCY_A = r"""
CASE WHEN t IN ({codes}) THEN t
  WHEN regexp_matches(t, '^(GBp|GBX)$') OR regexp_matches(u, 'PENCE|STERLING|£|\bSTG\b|\bGBX\b') THEN 'GBP'
  WHEN regexp_matches(t, '^(ZAc|ZAX)$') OR regexp_matches(u, '\bRAND\b|ZAR CENTS') THEN 'ZAR'
  WHEN regexp_matches(t, '^USc$') OR regexp_matches(u, 'US CENTS|US\$|U\.S\. DOLLAR|\bUSX\b') THEN 'USD'
  WHEN regexp_matches(t, '^EUc$') OR regexp_matches(u, 'EUROCENT|EUR CENT|^EUROS?$|€') THEN 'EUR'
  WHEN regexp_matches(u, '\bILA\b|AGOROT|\bNIS\b|₪') THEN 'ILS'
  WHEN regexp_matches(u, '¥|\bYEN\b') THEN 'JPY'
  WHEN u IN ('A$', 'AU$') THEN 'AUD' WHEN u IN ('C$', 'CA$') THEN 'CAD' WHEN u IN ('SFR', 'FR.') THEN 'CHF'
  ELSE nullif(regexp_extract(u, '(^|[^A-Z])({alt})($|[^A-Z])', 2), '') END
"""
_CODES = ("USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD", "SGD", "HKD", "SEK", "PLN", "ILS", "ZAR", "MXN")
_CCY = _CCY_A.format(codes=", ".join(f"'{c}'" for c in _CODES), alt="|".join(_CODES))

_QUOTES = f"""
q0 AS (
  SELECT DISTINCT as_of_date, loaded_at, rate_id, CAST(usd_rate AS DOUBLE) AS rate, trim(ccy) AS t, upper(trim(ccy)) AS u
  FROM fx_rates WHERE usd_rate IS NOT NULL AND as_of_date IS NOT NULL),
quotes AS (
  SELECT as_of_date, loaded_at, rate_id,
    CASE WHEN regexp_matches(u, '^USD ?[/-]? ?({'|'.join(_CODES[1:])})$') THEN right(u, 3) WHEN regexp_matches(u, '^({'|'.join(_CODES[1:])}) ?[/-]? ?USD$') THEN left(u, 3) ELSE {_CCY} END AS ccy,
    CASE WHEN regexp_matches(u, '^USD ?[/-]? ?({'|'.join(_CODES[1:])})$') THEN 1 / rate WHEN regexp_matches(u, '100') THEN rate / 100 ELSE rate END AS usd
  FROM q0)
"""

_ALT = "|".join(_CODES)


def _ccy_any(t: str) -> str:
    """Currency that a text of venue b names."""
    u = f"upper({t})"
    return f"""CASE WHEN {t} IN ({', '.join(f"'{c}'" for c in _CODES)}) THEN {t} WHEN {t} IS NULL OR {t} = '' THEN NULL
  WHEN {t} = 'GBp' THEN 'GBP' WHEN {t} = 'ZAc' THEN 'ZAR' WHEN {t} = 'USc' THEN 'USD' WHEN {t} = 'EUc' THEN 'EUR'
  WHEN regexp_matches({u}, '(^|[^A-Z])(K|M|T|MIO)?({_ALT})(K|M|X)?($|[^A-Z])') THEN regexp_extract({u}, '(^|[^A-Z])(K|M|T|MIO)?({_ALT})(K|M|X)?($|[^A-Z])', 3)
  WHEN regexp_matches({u}, 'US\\$|U\\.S\\. DOLLAR|\\bUSX\\b|US CENTS') THEN 'USD' WHEN regexp_matches({u}, '\\bAU?\\$') THEN 'AUD' WHEN regexp_matches({u}, '\\bCA?\\$') THEN 'CAD'
  WHEN regexp_matches({u}, '¥|\\bYEN\\b') THEN 'JPY' WHEN regexp_matches({u}, '₪|\\bNIS\\b|AGOROT|\\bILA\\b') THEN 'ILS' WHEN regexp_matches({u}, '€|\\bEURO\\b|EUROCENT') THEN 'EUR'
  WHEN regexp_matches({u}, '£|\\bSTG\\b|STERLING|(^| )PENCE|\\bGBX\\b') THEN 'GBP' WHEN regexp_matches({u}, '\\bSFR\\b|\\bFR\\.') THEN 'CHF' WHEN regexp_matches({u}, '\\bRAND\\b|\\bZAX\\b') THEN 'ZAR' END"""


def _power(t: str) -> str:
    """Power of ten that a text states, or null."""
    u = f"upper({t})"
    one = f"({_ALT}|US\\$|€|£)"
    return f"""CASE WHEN {t} IS NULL OR {t} = '' OR {t} IN ({', '.join(f"'{c}'" for c in _CODES)}) THEN NULL
  WHEN {t} IN ('GBp', 'ZAc', 'USc', 'EUc') OR regexp_matches({u}, '\\b(GBX|ZAX|USX|ILA)\\b|PENCE|AGOROT|CENTS?\\b|MINOR UNITS|1/100') THEN -2
  WHEN regexp_matches({u}, '\\(100\\)|/100$|¥100|^100 ') THEN 2
  WHEN regexp_matches({u}, 'MILLIONS|\\b(MIO|MLN|MM|MN)\\b|1E6|\\bM({_ALT})\\b|{one}M$') THEN 6
  WHEN regexp_matches({u}, 'THOUSANDS?|TSD|''000|\\b000S?\\b|X1000|\\b[KT]({_ALT})\\b|K[€£]|{one} ?K$|: K$') THEN 3
  WHEN regexp_matches({u}, 'FULL AMOUNTS|IN UNITS|UNIT: 1$') THEN 0 END"""


_UNITS = f"""
WITH {_SNAPSHOTS}, {_QUOTES},
tick AS (SELECT isin, as_of_date, upper(ticker) AS ticker, lag(ticker) OVER (PARTITION BY isin ORDER BY as_of_date) AS before FROM filled),
steps AS (SELECT ticker, CAST(as_of_date AS TIMESTAMP) AS at, max(isin) AS isin FROM tick WHERE ticker IS NOT NULL AND (before IS NULL OR upper(before) <> ticker) GROUP BY ALL),
a AS (SELECT 'a' AS feed, trade_id AS row_id, upper(regexp_replace(isin, '[^A-Za-z0-9]', '', 'g')) AS isin, CAST(price AS DOUBLE) AS price, trade_ts AS ts, CAST(price AS DOUBLE) AS amount, trim(currency) AS t, trim(source_system) AS s FROM trade_feed_venue_a WHERE price IS NOT NULL),
b0 AS (SELECT id, exec_time, regexp_replace(upper(trim(ticker)), '[. ][A-Z]{{1,2}}$', '') AS ticker, CAST(gross_amount AS DOUBLE) / CAST(qty AS DOUBLE) AS price, CAST(gross_amount AS DOUBLE) AS amount, trim(ccy) AS t, trim(source_system) AS s FROM trade_feed_venue_b WHERE gross_amount IS NOT NULL),
b AS (SELECT 'b' AS feed, id AS row_id, isin, price, exec_time AS ts, amount, t, s FROM b0 ASOF LEFT JOIN steps ON b0.ticker = steps.ticker AND b0.exec_time >= steps.at),
rows AS (SELECT feed, row_id, isin, price, ts, amount, coalesce({_ccy_any('t')}, {_ccy_any('s')}) AS ccy, coalesce({_power('t')}, {_power('s')}) AS p FROM (SELECT * FROM a UNION ALL SELECT * FROM b)),
lev AS (SELECT ccy, log10(median(usd)) AS l FROM quotes WHERE ccy IS NOT NULL GROUP BY 1),
logs AS (SELECT r.*, CASE WHEN price > 0 THEN log10(price) + coalesce(p, 0) + l END AS lp FROM rows r LEFT JOIN lev USING (ccy) WHERE ccy IS NOT NULL),
med AS (SELECT isin, median(lp) AS m FROM logs WHERE isin IS NOT NULL AND lp IS NOT NULL GROUP BY 1 HAVING count(*) > 2),
judged AS (SELECT feed, row_id, ts, amount, ccy AS unit_ccy, CASE WHEN p IS NOT NULL THEN p WHEN abs(lp - m - 2) < 0.5 THEN -2 WHEN abs(lp - m + 3) < 0.5 THEN 3 WHEN abs(lp - m + 6) < 0.5 THEN 6 ELSE 0 END AS pow FROM logs LEFT JOIN med USING (isin))
"""

ORACLES = {
    "p1_found": f"WITH {_SNAPSHOTS} SELECT isin, CAST(strftime(valid_from, '%Y%m%d') AS BIGINT) AS valid_from, coalesce(CAST(strftime(valid_to, '%Y%m%d') AS BIGINT), 99991231) AS valid_to FROM versions",
    "p1_history": f"WITH {_SNAPSHOTS} SELECT * FROM versions",
    "p2_found": f"""
WITH {_QUOTES},
trades AS (SELECT trade_id, trade_ts, ccy FROM (SELECT trade_id, trade_ts, {_CCY} AS ccy FROM (SELECT trade_id, trade_ts, trim(currency) AS t, upper(trim(currency)) AS u FROM trade_feed_venue_a WHERE trade_ts IS NOT NULL)) WHERE ccy IS NOT NULL),
marks AS (
  SELECT ccy, vis, max(ROW(as_of_date, loaded_at, rate_id)) OVER (PARTITION BY ccy ORDER BY vis RANGE UNBOUNDED PRECEDING) AS best
  FROM (SELECT *, greatest(CAST(as_of_date AS TIMESTAMP), loaded_at) AS vis FROM quotes WHERE ccy IS NOT NULL)),
steps AS (SELECT DISTINCT ccy, vis, best FROM marks),
final_day AS (SELECT ccy, CAST(as_of_date AS TIMESTAMP) AS day, max(ROW(as_of_date, loaded_at, rate_id)) AS best FROM quotes WHERE ccy IS NOT NULL GROUP BY ALL),
k AS (SELECT t.*, s.best AS known FROM trades t ASOF JOIN steps s ON t.ccy = s.ccy AND t.trade_ts >= s.vis),
b AS (SELECT k.*, f.best AS final FROM k ASOF JOIN final_day f ON k.ccy = f.ccy AND k.trade_ts >= f.day)
SELECT trade_id, known[3] AS rate_id FROM b WHERE known[3] <> final[3]""",
    "p5_found": f"{_UNITS} SELECT feed, row_id, unit_ccy, CAST(pow AS BIGINT) AS unit_pow10 FROM judged WHERE pow <> 0",
    "p5_amounts": f"""{_UNITS},
day_rate AS (SELECT ccy, CAST(as_of_date AS TIMESTAMP) AS day, arg_max(usd, ROW(loaded_at, rate_id)) AS usd FROM quotes WHERE ccy IS NOT NULL AND usd > 0 GROUP BY ALL),
priced AS (SELECT j.*, CASE WHEN unit_ccy = 'USD' AND ts IS NOT NULL THEN 1 ELSE r.usd END AS usd FROM judged j ASOF LEFT JOIN day_rate r ON j.unit_ccy = r.ccy AND j.ts >= r.day)
SELECT feed, row_id, unit_ccy || '|' || CASE pow WHEN -2 THEN 'c' WHEN 2 THEN 'h' WHEN 3 THEN 'k' WHEN 6 THEN 'm' ELSE '1' END AS unit, CAST(round(CAST(amount * (pow(CAST(10 AS DOUBLE), pow) * usd) AS DECIMAL(38,8)), 2) AS DOUBLE) AS amount_usd FROM priced""",
    "p3_found": f"WITH {_ORPHANS} SELECT DISTINCT src_table, src_field, row_id, state FROM orphans",
    "p3_counts": f"WITH {_ORPHANS} SELECT src_table, src_field, period, state, count(*) AS n FROM orphans GROUP BY ALL",
}
