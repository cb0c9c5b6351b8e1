"""The catalog's queries as plain SQL over the same tables, for a second engine."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import combinations, product

from seriesmill.config import CORRELATION_METRICS, INDICATORS, TIERS, Settings

ORACLES: dict[str, str] = {}

BASE = """
o AS (SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS d, o_custkey,
             CAST(ROUND(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
rk AS (SELECT o_custkey, SUM(cents) AS tot FROM o GROUP BY o_custkey),
top AS (SELECT o_custkey FROM
        (SELECT o_custkey, ROW_NUMBER() OVER (ORDER BY tot DESC, o_custkey) AS r,
                COUNT(*) OVER () AS n FROM rk) z WHERE r * 100 <= n),
day AS (SELECT o.asset, o.d, (o.d - DATE '1995-01-01') AS dn,
               COUNT(*) AS tx, COUNT(DISTINCT o.o_custkey) AS act, SUM(cents) AS cap,
               SUM(CASE WHEN cents >= 10000000 THEN 1 ELSE 0 END) AS t1,
               SUM(CASE WHEN cents >= 25000000 THEN 1 ELSE 0 END) AS t2,
               SUM(CASE WHEN cents >= 40000000 THEN 1 ELSE 0 END) AS t3,
               SUM(CASE WHEN top.o_custkey IS NOT NULL THEN cents ELSE 0 END) AS topc
        FROM o LEFT JOIN top ON o.o_custkey = top.o_custkey GROUP BY o.asset, o.d),
base AS (SELECT asset, d AS time,
    CAST(cap AS DOUBLE) / tx / 100 AS "PriceUSD", CAST(tx AS DOUBLE) AS "TxCnt",
    CAST(act AS DOUBLE) AS "AdrActCnt", CAST(cap AS DOUBLE) / 100 AS "CapMrktCurUSD",
    CAST(SUM(tx) OVER w AS DOUBLE) AS "AdrBalCnt",
    CAST(SUM(t1) OVER w AS DOUBLE) AS "AdrBalUSD10KCnt",
    CAST(SUM(t2) OVER w AS DOUBLE) AS "AdrBalUSD100KCnt",
    CAST(SUM(t3) OVER w AS DOUBLE) AS "AdrBalUSD1MCnt",
    CAST(SUM(t3) OVER m AS DOUBLE) AS "AdrBal1in10KCnt",
    CAST(SUM(t1) OVER m AS DOUBLE) AS "AdrBal1in100KCnt",
    CAST(SUM(cap) OVER w AS DOUBLE) AS "SplyCur",
    CAST(SUM(topc) OVER w AS DOUBLE) AS "SplyAdrTop1Pct",
    CAST(SUM(cap) OVER (PARTITION BY asset ORDER BY dn RANGE BETWEEN 179 PRECEDING AND CURRENT ROW) AS DOUBLE) AS "SplyAct180d",
    CAST(SUM(cap) OVER (PARTITION BY asset ORDER BY dn RANGE BETWEEN 364 PRECEDING AND CURRENT ROW) AS DOUBLE) AS "SplyAct1yr",
    CAST(SUM(cap) OVER (PARTITION BY asset ORDER BY dn RANGE BETWEEN 729 PRECEDING AND CURRENT ROW) AS DOUBLE) AS "SplyAct2yr",
    2.0 * (CAST(cap AS DOUBLE) / tx) / (CAST(SUM(cap) OVER w AS DOUBLE) / SUM(tx) OVER w) AS "CapMVRVCur"
  FROM day
  WINDOW w AS (PARTITION BY asset ORDER BY dn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         m AS (PARTITION BY asset ORDER BY dn ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)),
v1 AS (SELECT *, "PriceUSD" / NULLIF(LAG("PriceUSD", 1) OVER s, 0) - 1 AS ret,
              100 * ("PriceUSD" / NULLIF(LAG("PriceUSD", 30) OVER s, 0) - 1) AS "ROI30d",
              100 * ("PriceUSD" / NULLIF(LAG("PriceUSD", 365) OVER s, 0) - 1) AS "ROI1yr",
              "CapMrktCurUSD" / NULLIF(AVG("TxCnt") OVER (PARTITION BY asset ORDER BY time
                  ROWS BETWEEN 89 PRECEDING AND CURRENT ROW), 0) AS "NVTAdj90"
       FROM base WINDOW s AS (PARTITION BY asset ORDER BY time)),
v2 AS (SELECT *, AVG(ret) OVER (PARTITION BY asset ORDER BY time
              ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) AS ret_mean FROM v1),
m AS (SELECT *, SQRT(AVG((ret - ret_mean) * (ret - ret_mean)) OVER (PARTITION BY asset ORDER BY time
              ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)) AS "VtyDayRet30d" FROM v2)"""

DIRTY = BASE + """,
dirty AS (SELECT asset, time, 0 AS seq,
    CASE WHEN MOD(dayofyear(time), 17) IN (0, 1) THEN NULL
         WHEN MOD(dayofyear(time), 23) = 0 THEN CAST(0 AS DOUBLE)
         WHEN MOD(dayofyear(time), 29) = 0 THEN CAST('Infinity' AS DOUBLE)
         WHEN MOD(dayofyear(time), 31) < 10 THEN CAST(7 AS DOUBLE)
         ELSE "PriceUSD" END AS v FROM base
  UNION ALL
  SELECT asset, time, 1 AS seq, "PriceUSD" * 2 AS v FROM base WHERE MOD(dayofyear(time), 37) = 0),
fin AS (SELECT asset, time, seq, CASE WHEN isinf(v) OR isnan(v) THEN NULL ELSE v END AS v FROM dirty)"""

EVENTS = """
e AS (SELECT event_type AS asset, ts AS time, event_id, value AS "Val" FROM events)"""

HOURS = """
m AS (SELECT event_type AS asset, date_trunc('hour', ts) AS time, CAST(COUNT(*) AS DOUBLE) AS "EvtCnt",
             AVG(value) AS "Val", CAST(COUNT(DISTINCT user_id) AS DOUBLE) AS "Users"
      FROM events GROUP BY 1, 2)"""

SERIES = "PARTITION BY asset ORDER BY time"


def rows(k: int) -> str:
    return f"({SERIES} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def add(
    name: str,
    ctes: str,
    source: str,
    text: Sequence[str] = (),
    real: Sequence[str] = (),
    whole: Sequence[str] = (),
    plain: Sequence[str] = (),
    where: str = "",
) -> None:
    """Outer projection with the same presentation as the catalog's.

    Events of equal time stand in order of their number.
    """
    if ctes.startswith(EVENTS):
        source = source.replace("ORDER BY time", "ORDER BY time, event_id")
    columns = [f'CAST("{n}" AS VARCHAR) AS "{n}"' for n in text]
    columns += [f'CAST(CAST("{n}" AS FLOAT) AS DOUBLE) + 0 AS "{n}"' for n in real]
    columns += [f'CAST("{n}" AS BIGINT) AS "{n}"' for n in whole]
    columns += [f'"{n}"' for n in plain]
    condition = f" WHERE {where}" if where else ""
    ORACLES[name] = f"WITH {ctes.strip()}\nSELECT {', '.join(columns)}\nFROM ({source}) q{condition}"


KEY = ("asset", "time")
HOLDERS = ("AdrBalCnt", "AdrBalUSD10KCnt", "AdrBalUSD100KCnt", "AdrBalUSD1MCnt")
BASE_NAMES = (
    "PriceUSD", "TxCnt", "AdrActCnt", "CapMrktCurUSD", *HOLDERS, "AdrBal1in10KCnt",
    "AdrBal1in100KCnt", "SplyCur", "SplyAdrTop1Pct", "SplyAct180d", "SplyAct1yr", "SplyAct2yr",
    "CapMVRVCur",
)
ALL_NAMES = (*BASE_NAMES, "ROI30d", "ROI1yr", "VtyDayRet30d", "NVTAdj90")


def union(parts: Iterable[str]) -> str:
    return "\nUNION ALL ".join(parts)


def moving(metric: str, windows: Sequence[int], source: str = "m") -> str:
    cols = ", ".join(f'AVG("{metric}") OVER {rows(k)} AS "{metric}_MA{k}days"' for k in windows)
    return f'SELECT asset, time, "{metric}", {cols} FROM {source}'


def volatility(metric: str, lag: int, k: int, source: str = "m") -> str:
    ret, mean = f"{metric}_return{lag}", f"{metric}_return{lag}_mean{k}"
    return f"""SELECT asset, time, "{metric}", "{ret}", "{mean}", "{metric}_lag{lag}",
        SQRT(AVG(("{ret}" - "{mean}") * ("{ret}" - "{mean}")) OVER {rows(k)}) AS "{metric}_RV{k}_return{lag}"
      FROM (SELECT *, AVG("{ret}") OVER {rows(k)} AS "{mean}"
        FROM (SELECT *, LAG("{metric}", {lag}) OVER ({SERIES}) AS "{metric}_lag{lag}",
                     "{metric}" / NULLIF(LAG("{metric}", {lag}) OVER ({SERIES}), 0) - 1 AS "{ret}"
              FROM {source}) a) b"""


def in_order(value: str, k: int) -> str:
    """Mean of the last k values, added up from the first to the last."""
    listed = f"list_filter(list({value}) OVER {rows(k)}, lambda x: x IS NOT NULL)"
    total = f"list_reduce(list_prepend(0.0::DOUBLE, {listed}), lambda a, b: a + b)"
    return f"{total} / NULLIF(COUNT({value}) OVER {rows(k)}, 0)"


def volatility_names(metric: str, lag: int, k: int) -> tuple[str, ...]:
    return (
        metric, f"{metric}_return{lag}", f"{metric}_return{lag}_mean{k}", f"{metric}_lag{lag}",
        f"{metric}_RV{k}_return{lag}",
    )


def complete(names: Sequence[str]) -> str:
    return " AND ".join(f'"{n}" IS NOT NULL' for n in names)


def delta(metric: str, k: int, source: str = "m") -> str:
    lag = f'LAG("{metric}", {k}) OVER ({SERIES})'
    return f"""SELECT *, "{metric}" - {lag} AS "{metric}_delta_{k}d",
        ("{metric}" - {lag}) / NULLIF({lag}, 0) * 100 AS "{metric}_pct_change_{k}d" FROM {source}"""


def strict_mean(metric: str, source: str) -> str:
    name = f"{metric}_delta_30d"
    frame = f"({SERIES} ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)"
    return f"""SELECT asset, time, "{name}",
        CASE WHEN COUNT("{name}") OVER {frame} = 7 THEN AVG("{name}") OVER {frame} END AS "{name}_mean7"
      FROM ({delta(metric, 30, source)}) d"""


def interpolated(source: str, value: str, order: str) -> str:
    """Positional linear fill of one column of (asset, time, ..., value)."""
    up = "PARTITION BY asset ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    down = "PARTITION BY asset ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    v = f'"{value}"'
    return f"""SELECT * EXCLUDE ({v}, rn, pr, nr, pv, nv),
        COALESCE({v}, pv + (nv - pv) * (CAST(rn - pr AS DOUBLE) / NULLIF(nr - pr, 0)), pv, nv) AS {v}
      FROM (SELECT *, LAST_VALUE(CASE WHEN {v} IS NOT NULL THEN rn END IGNORE NULLS) OVER ({up}) AS pr,
                   FIRST_VALUE(CASE WHEN {v} IS NOT NULL THEN rn END IGNORE NULLS) OVER ({down}) AS nr,
                   LAST_VALUE({v} IGNORE NULLS) OVER ({up}) AS pv,
                   FIRST_VALUE({v} IGNORE NULLS) OVER ({down}) AS nv
            FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY asset ORDER BY {order}) AS rn FROM {source}) a) b"""


def newest(source: str, order: str = "time, seq") -> str:
    return f"""SELECT * EXCLUDE (r) FROM (SELECT *, ROW_NUMBER() OVER
        (PARTITION BY asset, time ORDER BY seq DESC) AS r FROM ({source}) s) t WHERE r = 1"""


def flat(metric: str, k: int, source: str = "m") -> str:
    return f"""SELECT asset, time, '{metric}' AS metric, "{metric}" AS value,
        SUM(same) OVER {rows(k)} AS unchanged_count
      FROM (SELECT *, CASE WHEN "{metric}" = LAG("{metric}") OVER ({SERIES}) THEN 1 ELSE 0 END AS same
            FROM {source}) a"""


def steps(source: str = "m", days: str = "CAST(time - LAG(time) OVER (PARTITION BY asset ORDER BY time) AS DOUBLE)") -> str:
    return f"""SELECT asset, time AS gap_end, LAG(time) OVER ({SERIES}) AS gap_start,
        {days} AS days_gap FROM {source}"""


HOUR_DAYS = (
    f"CAST(epoch_us(time) - epoch_us(LAG(time) OVER ({SERIES})) AS DOUBLE) / 86400000000.0"
)


def report(metrics: Sequence[str], k: int, limit: str, source: str = "m", days: str | None = None) -> str:
    gap = steps(source, days) if days else steps(source)
    return union(
        f"""SELECT a.asset, '{n}' AS feature, total_records, earliest, latest,
             COALESCE(gap_count, 0) AS gap_count, zero_count, COALESCE(flat_count, 0) AS repeated_values_count
           FROM (SELECT asset, COUNT(*) AS total_records, MIN(time) AS earliest, MAX(time) AS latest,
                   SUM(CASE WHEN "{n}" IS NULL OR "{n}" = 0 THEN 1 ELSE 0 END) AS zero_count
                 FROM {source} GROUP BY asset) a
           LEFT JOIN (SELECT asset, COUNT(*) AS gap_count FROM ({gap}) g WHERE days_gap > {limit}
                 GROUP BY asset) b ON a.asset = b.asset
           LEFT JOIN (SELECT asset, COUNT(*) AS flat_count FROM ({flat(n, k, source)}) f
                 WHERE unchanged_count = {k} GROUP BY asset) c ON a.asset = c.asset"""
        for n in metrics
    )


def quantiles(source: str, value: str, extra: str = "") -> str:
    cuts = ", ".join(
        f'QUANTILE_CONT("{value}", {p}) AS q{round(p * 100)}' for p in (0.1, 0.25, 0.5, 0.75, 0.9)
    )
    return f"SELECT asset, {cuts}{extra} FROM ({source}) v GROUP BY asset"


def bands(source: str, value: str) -> str:
    v = f's."{value}"'
    return f"""SELECT s.asset, s.time, {v}, CASE WHEN {v} IS NULL THEN NULL WHEN {v} < q10 THEN 'very_low'
        WHEN {v} < q25 THEN 'low' WHEN {v} < q50 THEN 'normal' WHEN {v} < q75 THEN 'elevated'
        WHEN {v} < q90 THEN 'high' ELSE 'extreme' END AS band
      FROM ({source}) s JOIN ({quantiles(source, value)}) c ON s.asset = c.asset"""


def histogram(source: str, value: str) -> str:
    return f"""SELECT g.asset, g.bin, lo + (hi - lo) / 50 * (g.bin - 1) AS bin_start,
        COALESCE(k.n, 0) AS n, COALESCE(k.n, 0) / (total * ((hi - lo) / 50)) AS density
      FROM (SELECT r.*, b.bin FROM
              (SELECT asset, MIN("{value}") AS lo, MAX("{value}") AS hi, COUNT("{value}") AS total
               FROM {source} GROUP BY asset) r CROSS JOIN (SELECT UNNEST(RANGE(1, 51)) AS bin) b) g
      LEFT JOIN (SELECT s.asset, LEAST(CAST(FLOOR((s."{value}" - lo) / (hi - lo) * 50) AS BIGINT) + 1, 50) AS bin,
                        COUNT(*) AS n
                 FROM {source} s JOIN (SELECT asset, MIN("{value}") AS lo, MAX("{value}") AS hi
                                       FROM {source} GROUP BY asset) x ON s.asset = x.asset
                 GROUP BY 1, 2) k ON g.asset = k.asset AND g.bin = k.bin"""


def density(source: str, value: str) -> str:
    return f"""SELECT g.asset, g.point, g.x,
        SUM(EXP(-0.5 * ((g.x - s."{value}") / h) * ((g.x - s."{value}") / h))) / (MAX(n) * MAX(h) * SQRT(2 * PI())) AS density
      FROM (SELECT asset, n, h, b.point, lo + (hi - lo) / 99.0 * b.point AS x FROM
              (SELECT asset, MIN("{value}") AS lo, MAX("{value}") AS hi, COUNT("{value}") AS n,
                      POWER(COUNT("{value}"), -0.2) * STDDEV_SAMP("{value}") AS h
               FROM {source} GROUP BY asset) r CROSS JOIN (SELECT UNNEST(RANGE(0, 100)) AS point) b) g
      JOIN {source} s ON s.asset = g.asset GROUP BY g.asset, g.point, g.x"""


def extremes(source: str, value: str) -> str:
    v = f'"{value}"'
    return f"""SELECT p.asset, peak_time, peak_value, trough_time, trough_value
      FROM (SELECT asset, time AS peak_time, {v} AS peak_value, ROW_NUMBER() OVER
              (PARTITION BY asset ORDER BY {v} DESC, time) AS r FROM {source} WHERE {v} IS NOT NULL) p
      JOIN (SELECT asset, time AS trough_time, {v} AS trough_value, ROW_NUMBER() OVER
              (PARTITION BY asset ORDER BY {v}, time) AS r FROM {source} WHERE {v} IS NOT NULL) t
        ON p.asset = t.asset AND p.r = 1 AND t.r = 1"""


def describe(source: str, metrics: Sequence[str]) -> str:
    return union(
        f"""SELECT asset, '{n}' AS metric, COUNT("{n}") AS count, AVG("{n}") AS mean,
            STDDEV_SAMP("{n}") AS std, MIN("{n}") AS min, QUANTILE_CONT("{n}", 0.25) AS p25,
            QUANTILE_CONT("{n}", 0.5) AS p50, QUANTILE_CONT("{n}", 0.75) AS p75, MAX("{n}") AS max
          FROM {source} GROUP BY asset"""
        for n in metrics
    )


def correlations(source: str, pairs: Iterable[tuple[str, str]]) -> str:
    return union(
        f"""SELECT asset, {i} AS pair, '{a}' AS a, '{b}' AS b,
            COVAR_POP("{a}", "{b}") / NULLIF(STDDEV_POP(CASE WHEN "{b}" IS NOT NULL THEN "{a}" END)
              * STDDEV_POP(CASE WHEN "{a}" IS NOT NULL THEN "{b}" END), 0) AS corr
          FROM {source} GROUP BY asset"""
        for i, (a, b) in enumerate(pairs)
    )


def runs(source: str, label: str) -> str:
    """Runs of equal label over adjacent rows."""
    return f"""SELECT asset, label, MIN(time) AS start, MAX(time) AS "end", COUNT(*) AS n_rows
      FROM (SELECT *, SUM(CASE WHEN label IS NOT DISTINCT FROM was AND rn > 1 THEN 0 ELSE 1 END) OVER
              ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
            FROM (SELECT *, {label} AS label, LAG({label}) OVER ({SERIES}) AS was,
                         ROW_NUMBER() OVER ({SERIES}) AS rn FROM ({source}) s) a) b
      WHERE label IS NOT NULL GROUP BY asset, label, run"""


def linked(source: str, label: str, days: str) -> str:
    """Rows of one label linked while at most one whole day apart."""
    w = "PARTITION BY asset, label ORDER BY time"
    return f"""SELECT asset, label, MIN(time) AS start, MAX(time) AS "end", COUNT(*) AS n_rows
      FROM (SELECT *, SUM(CASE WHEN FLOOR(step) <= 1 THEN 0 ELSE 1 END) OVER
              ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
            FROM (SELECT *, {days.format(w=w)} AS step
                  FROM (SELECT *, {label} AS label FROM ({source}) s WHERE {label} IS NOT NULL) l) a) b
      GROUP BY asset, label, run HAVING COUNT(*) >= 2"""


def zone(value: str) -> str:
    return f"""CASE WHEN {value} > 3 THEN 'overvalued' WHEN {value} > 2.5 THEN 'caution'
      WHEN {value} > 2 THEN 'warming up' WHEN {value} > 1 THEN 'fair' WHEN {value} > 0 THEN 'undervalued' END"""


TIER_SQL = """SELECT asset, time, "AdrBalCnt", "AdrActCnt",
    CASE WHEN "AdrBalCnt" - "AdrBalUSD10KCnt" < 0 THEN 0 ELSE "AdrBalCnt" - "AdrBalUSD10KCnt" END AS small,
    CASE WHEN "AdrBalUSD10KCnt" - "AdrBalUSD100KCnt" < 0 THEN 0 ELSE "AdrBalUSD10KCnt" - "AdrBalUSD100KCnt" END AS medium,
    CASE WHEN "AdrBalUSD100KCnt" - "AdrBalUSD1MCnt" < 0 THEN 0 ELSE "AdrBalUSD100KCnt" - "AdrBalUSD1MCnt" END AS large,
    "AdrBalUSD1MCnt" AS whale FROM base"""

DERIVED = BASE + """,
d1 AS (SELECT asset, time, 1 - "SplyAdrTop1Pct" / NULLIF("SplyCur", 0) AS decentralization_index,
    "SplyAdrTop1Pct" / NULLIF("SplyCur", 0) AS whale_dominance,
    1 - "SplyAct180d" / NULLIF("SplyCur", 0) AS dormant_180d_pct,
    1 - "SplyAct1yr" / NULLIF("SplyCur", 0) AS dormant_1yr_pct,
    1 - "SplyAct2yr" / NULLIF("SplyCur", 0) AS dormant_2yr_pct,
    "AdrBal1in10KCnt" AS w, LAG("AdrBal1in10KCnt") OVER (PARTITION BY asset ORDER BY time) AS wl FROM base),
d AS (SELECT *, (w - wl) / NULLIF(wl, 0) AS whale_activity_change_rate,
    dormant_1yr_pct - LAG(dormant_1yr_pct) OVER (PARTITION BY asset ORDER BY time) AS dormancy_flow FROM d1)"""

REGIME = """SELECT asset, time, whale_activity_change_rate, dormancy_flow,
    CASE WHEN whale_activity_change_rate > 0 AND dormancy_flow < 0 THEN 'distribution'
         WHEN whale_activity_change_rate > 0 AND dormancy_flow > 0 THEN 'reshuffling'
         WHEN whale_activity_change_rate < 0 AND dormancy_flow > 0 THEN 'accumulation'
         WHEN whale_activity_change_rate < 0 AND dormancy_flow < 0 THEN 'cashout' END AS regime FROM d"""

# --- sources and sinks
add("src_csv", BASE, "SELECT * FROM base", KEY, ("PriceUSD", "TxCnt"))
add("lookback_filter", BASE, "SELECT * FROM base WHERE time >= DATE '2001-08-01' - INTERVAL 730 DAY", KEY, ("PriceUSD",))
add("sink_table", BASE,
    """SELECT asset, time, "PriceUSD", CASE WHEN asset = '1-URGENT' THEN "TxCnt" + 1 ELSE "TxCnt" END AS "TxCnt" FROM base""",
    KEY, ("PriceUSD", "TxCnt"))
add("csv_line_breaks", BASE,
    """SELECT *, CASE WHEN day(time) % 3 > 0 THEN asset || chr(10) || chr(10) || '"' || strftime(time, '%Y-%m-%d') || '", noted' END AS "Note" FROM base""",
    (*KEY, "Note"), ("PriceUSD",))
add("table_versions", BASE, """SELECT asset, time, 1 AS version, "TxCnt" FROM base UNION ALL
    SELECT asset, time, 2 AS version, CASE WHEN asset = '1-URGENT' THEN "TxCnt" + 1 ELSE "TxCnt" END AS "TxCnt" FROM base""",
    KEY, ("TxCnt",), ("version",))
add("load_status", BASE, """SELECT asset, 1 AS version, 'loaded' AS status, '' AS detail, COUNT(*) AS n_rows, MIN(time) AS first_time, MAX(time) AS last_time
    FROM base GROUP BY asset UNION ALL
    SELECT asset, 2, CASE WHEN asset = '1-URGENT' THEN 'loaded' ELSE 'kept' END, CASE WHEN asset = '1-URGENT' THEN '' ELSE 'no such number' END,
      CASE WHEN asset = '1-URGENT' THEN COUNT(*) END, CASE WHEN asset = '1-URGENT' THEN MIN(time) END, CASE WHEN asset = '1-URGENT' THEN MAX(time) END
    FROM base WHERE asset IN ('1-URGENT', '2-HIGH') GROUP BY asset""",
    ("asset", "status", "detail", "first_time", "last_time"), whole=("version", "n_rows"))


def long_delta(metrics: Sequence[str]) -> str:
    return union(
        f"""SELECT asset, '{n}' AS metric, time, "{n}_delta_30d" AS delta, "{n}_pct_change_30d" AS pct_change
            FROM ({delta(n, 30)}) d""" for n in metrics
    )


CHANGED = Settings().delta_metrics
add("sink_csv", BASE, long_delta(("PriceUSD", "AdrActCnt")), ("asset", "metric", "time"), ("delta", "pct_change"))
add("feature_rolling_deltas", BASE, long_delta(CHANGED), ("asset", "metric", "time"), ("delta", "pct_change"))
add("feature_lag_volatility", BASE, union(
    'SELECT asset, \'{0}\' AS metric, time, "{0}" AS value, "{1}" AS return, "{2}" AS return_mean, "{3}" AS lag, "{4}" AS volatility '.format(
        *volatility_names(n, 1, 30)) + f"FROM ({volatility(n, 1, 30)}) v WHERE {complete(volatility_names(n, 1, 30))}"
    for n in CHANGED), ("asset", "metric", "time"), ("value", "return", "return_mean", "lag", "volatility"))
add("src_results", BASE, union(
    f"""SELECT asset, '{n}' AS metric, time, "{n}" AS value, "{n}_MA7days" AS ma7, "{n}_MA30days" AS ma30,
        "{n}_MA90days" AS ma90 FROM ({moving(n, (7, 30, 90))}) a""" for n in ALL_NAMES),
    ("asset", "metric", "time"), ("value", "ma7", "ma30", "ma90"))
add("categorize", BASE, union(
    f"""SELECT asset || '_{n}_{kind}' AS file_name, COUNT(*) AS n_rows, '{label}' AS category FROM base GROUP BY asset"""
    for n, (kind, label) in product(("PriceUSD", "AdrActCnt"), (
        ("moving_averages", "Moving Averages"), ("lag_volatility", "Lag & Volatility"), ("rolling_deltas", "Rolling Deltas")))),
    ("file_name", "category"), whole=("n_rows",))
add("list_tables", BASE, "SELECT asset, COUNT(*) AS n_rows, MIN(time) AS first_time, MAX(time) AS last_time FROM base GROUP BY asset",
    ("asset", "first_time", "last_time"), whole=("n_rows",))
add("preview", BASE, f"SELECT *, ROW_NUMBER() OVER ({SERIES}) AS r FROM base", KEY, ("PriceUSD", "TxCnt"), where="r <= 10")

add("ordered_by_time", BASE, f"SELECT *, ROW_NUMBER() OVER ({SERIES}) - 1 AS position FROM base", KEY, ("PriceUSD",), ("position",))
add("numeric_values", BASE, union([*[f"SELECT asset, '{n}' AS metric, COUNT(\"{n}\") AS n_values FROM m GROUP BY asset" for n in ("PriceUSD", "TxCnt", "ROI1yr")],
    "SELECT asset, 'small' AS metric, COUNT(*) AS n_values FROM m GROUP BY asset"]), ("asset", "metric"), whole=("n_values",))
add("metrics_with_values", BASE, "SELECT * FROM base", KEY, ("PriceUSD", "TxCnt"))
add("chart_columns", BASE, delta("PriceUSD", 30), KEY, ("PriceUSD_delta_30d", "PriceUSD_pct_change_30d"))

# --- cleaning
SEQ = ("asset", "time")
add("clean_nonfinite", DIRTY, "SELECT * FROM fin", SEQ, ("v",), ("seq",))
add("interpolate_linear", DIRTY, interpolated("fin", "v", "time, seq"), SEQ, ("v",), ("seq",))
add("dedup_keep_last", DIRTY, newest("SELECT * FROM fin"), SEQ, ("v",), ("seq",))
add("clean_series", DIRTY, newest(interpolated("fin", "v", "time, seq")), SEQ, ("v",))

# --- windows
add("moving_average", BASE, moving("PriceUSD", (7,)), KEY, ("PriceUSD", "PriceUSD_MA7days"))
add("moving_average_multi", BASE, moving("PriceUSD", (7, 30, 90)), KEY,
    ("PriceUSD", "PriceUSD_MA7days", "PriceUSD_MA30days", "PriceUSD_MA90days"))
add("lag_feature", BASE, f'SELECT *, LAG("PriceUSD", 7) OVER ({SERIES}) AS "PriceUSD_lag7" FROM base', KEY, ("PriceUSD", "PriceUSD_lag7"))
add("lag_return", BASE,
    f"""SELECT *, "AdrBalUSD1MCnt" / NULLIF(LAG("AdrBalUSD1MCnt", 7) OVER ({SERIES}), 0) - 1 AS "AdrBalUSD1MCnt_return7" FROM base""",
    KEY, ("AdrBalUSD1MCnt", "AdrBalUSD1MCnt_return7"))
add("return_mean", BASE, volatility("PriceUSD", 7, 30), KEY, ("PriceUSD_return7", "PriceUSD_return7_mean30"))
add("rolling_volatility", BASE, volatility("PriceUSD", 7, 30), KEY, volatility_names("PriceUSD", 7, 30),
    where=complete(volatility_names("PriceUSD", 7, 30)))
add("rolling_delta", BASE, delta("AdrBalUSD1MCnt", 30), KEY, ("AdrBalUSD1MCnt_delta_30d", "AdrBalUSD1MCnt_pct_change_30d"))
add("first_difference", BASE, f'SELECT *, "AdrActCnt" - LAG("AdrActCnt") OVER ({SERIES}) AS "AdrActCnt_diff" FROM base', KEY, ("AdrActCnt", "AdrActCnt_diff"))
add("delta_ma_strict", BASE, strict_mean("AdrActCnt", "base"), KEY, ("AdrActCnt_delta_30d", "AdrActCnt_delta_30d_mean7"))


def growth(names: Sequence[str], source: str) -> str:
    first = f"({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    cols = ", ".join(f'("{n}" / NULLIF(FIRST_VALUE("{n}") OVER {first}, 0) - 1) * 100 AS "{n}_growth_pct"' for n in names)
    return f"SELECT asset, time, {cols} FROM ({source}) g"


GROWN = ("AdrBalCnt", *TIERS)
add("growth_from_base", BASE, growth(GROWN, TIER_SQL), KEY, [f"{n}_growth_pct" for n in GROWN])
add("change_rate", BASE,
    f"""SELECT *, ("AdrBal1in10KCnt" - LAG("AdrBal1in10KCnt") OVER ({SERIES})) / NULLIF(LAG("AdrBal1in10KCnt") OVER ({SERIES}), 0)
        AS "AdrBal1in10KCnt_change_rate1" FROM base""", KEY, ("AdrBal1in10KCnt", "AdrBal1in10KCnt_change_rate1"))
add("delta_sign", BASE,
    f"""SELECT *, CASE WHEN "AdrActCnt_delta_30d" > 0 THEN 'positive' ELSE 'negative' END AS delta_class FROM ({delta("AdrActCnt", 30)}) d""",
    (*KEY, "delta_class"), ("AdrActCnt_delta_30d",))

# --- quality
CHECKED = ("PriceUSD", "TxCnt", "AdrActCnt", "AdrBal1in10KCnt", *HOLDERS[1:])
add("dq_gaps", BASE, steps("base"), ("asset", "gap_start", "gap_end"), ("days_gap",), where="days_gap > 1")
add("dq_zero_null", BASE, union(
    f"""SELECT asset, '{n}' AS metric, COUNT(*) AS total_records, MIN(time) AS earliest, MAX(time) AS latest,
        SUM(CASE WHEN "{n}" IS NULL OR "{n}" = 0 THEN 1 ELSE 0 END) AS zero_count FROM base GROUP BY asset""" for n in CHECKED),
    ("asset", "metric", "earliest", "latest"), whole=("total_records", "zero_count"))
add("dq_flat_runs", BASE, union(flat(n, 7, "base") for n in CHECKED), ("asset", "time", "metric"), ("value",), ("unchanged_count",),
    where="unchanged_count = 7")
add("dq_report", BASE, report(Settings().quality_metrics, 7, "1"), ("asset", "feature", "earliest", "latest"),
    whole=("total_records", "gap_count", "zero_count", "repeated_values_count"))
add("dq_report_dirty", DIRTY, report(("v",), 7, "1", "fin").replace("ORDER BY time", "ORDER BY time, seq"), ("asset", "feature"),
    whole=("total_records", "gap_count", "zero_count", "repeated_values_count"))


def rule(name: str, test: str, severity: str) -> str:
    return f"""SELECT asset, '{name}' AS rule, '{severity}' AS severity, SUM(CASE WHEN {test} THEN 1 ELSE 0 END) AS violations,
        BOOL_OR(r = 1 AND {test}) AS latest_violates
      FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY asset ORDER BY time DESC) AS r FROM base) a GROUP BY asset"""


add("dq_consistency", BASE, union((
    rule("over_100k_exceeds_total", '"AdrBalUSD100KCnt" > "AdrBalCnt"', "warning"),
    rule("over_1m_exceeds_over_100k", '"AdrBalUSD1MCnt" > "AdrBalUSD100KCnt"', "error"))),
    ("asset", "rule", "severity"), whole=("violations",), plain=("latest_violates",))
add("dq_null_counts", BASE, union(
    f"""SELECT asset, '{n}' AS metric, SUM(CASE WHEN "{n}" IS NULL THEN 1 ELSE 0 END) AS null_count FROM m GROUP BY asset""" for n in ALL_NAMES),
    ("asset", "metric"), whole=("null_count",))
add("dq_nonpositive", BASE, union(
    f"""SELECT asset, '{n}' AS metric, SUM(CASE WHEN "{n}" <= 0 THEN 1 ELSE 0 END) AS nonpositive_count FROM base GROUP BY asset"""
    for n in ("AdrActCnt", *HOLDERS[1:])), ("asset", "metric"), whole=("nonpositive_count",))
LATEST = "SELECT *, ROW_NUMBER() OVER (PARTITION BY asset ORDER BY time DESC) AS r FROM {}"
add("latest_summary", BASE, LATEST.format("base"), KEY, ("AdrBalCnt", "AdrBalUSD100KCnt", "AdrBalUSD1MCnt"), where="r = 1")

# --- joins and reshaping
add("join_metrics", BASE, 'SELECT * FROM base', KEY, ("AdrActCnt", *HOLDERS))
add("long_to_wide", BASE, 'SELECT * FROM base', KEY, ("PriceUSD", "TxCnt", "CapMVRVCur"))
add("holder_tiers", BASE, TIER_SQL, KEY, TIERS)
add("tier_distribution", BASE, union(
    f"""SELECT asset, time, '{n}' AS tier, {n} AS holders, 100 * {n} / NULLIF(small + medium + large + whale, 0) AS share_pct
        FROM ({LATEST.format(f"({TIER_SQL}) t")}) l WHERE r = 1 AND {n} > 0""" for n in TIERS),
    ("asset", "time", "tier"), ("holders", "share_pct"))
add("yoy_by_day", BASE, 'SELECT asset, year(time) AS year, dayofyear(time) AS day_of_year, "AdrActCnt" FROM base',
    ("asset",), ("AdrActCnt",), ("year", "day_of_year"))
add("yoy_pivot", BASE, """SELECT asset, dayofyear(time) AS day_of_year, 'y' || year(time) AS year, MAX("AdrActCnt") AS value
        FROM base GROUP BY 1, 2, 3""", ("asset", "year"), ("value",), ("day_of_year",))

# --- statistics
RV = "AdrActCnt_RV30_return1"
MOVED = f"""SELECT * FROM ({volatility("AdrActCnt", 1, 30, "base")}) x WHERE {complete(volatility_names("AdrActCnt", 1, 30))}"""
add("percentiles", BASE, quantiles(MOVED, RV), ("asset",), ("q10", "q25", "q50", "q75", "q90"))
# A band may begin at a value that several rows have, so its last bit counts.
SAME_BITS = MOVED.replace('AVG("AdrActCnt_return1") OVER ' + rows(30), in_order('"AdrActCnt_return1"', 30))
SQUARE = '("AdrActCnt_return1" - "AdrActCnt_return1_mean30") * ("AdrActCnt_return1" - "AdrActCnt_return1_mean30")'
SAME_BITS = SAME_BITS.replace(f"AVG({SQUARE}) OVER " + rows(30), in_order(SQUARE, 30))
add("volatility_regime", BASE, bands(SAME_BITS, RV), ("asset", "time", "band"), (RV,))
add("histogram_density", BASE, histogram("base", "AdrActCnt"), ("asset",), ("bin_start", "density"), ("bin", "n"))
add("kde_grid", BASE, density("base", "AdrActCnt"), ("asset",), ("x", "density"), ("point",))
add("mean_median", BASE, 'SELECT asset, AVG("AdrActCnt") AS mean, MEDIAN("AdrActCnt") AS median FROM base GROUP BY asset', ("asset",), ("mean", "median"))
add("peak_trough", BASE, extremes("base", "AdrActCnt"), ("asset", "peak_time", "trough_time"), ("peak_value", "trough_value"))
add("ols_fit", BASE,
    """SELECT asset, REGR_SLOPE("ROI1yr", "CapMrktCurUSD") AS slope, REGR_INTERCEPT("ROI1yr", "CapMrktCurUSD") AS intercept,
        REGR_R2("ROI1yr", "CapMrktCurUSD") AS r2, REGR_COUNT("ROI1yr", "CapMrktCurUSD") AS n FROM m GROUP BY asset""",
    ("asset",), ("slope", "intercept", "r2"), ("n",))
PAIRS = correlations("m", combinations(CORRELATION_METRICS, 2))
add("correlation_matrix", BASE, union((
    f"SELECT asset, a, b, corr FROM ({PAIRS}) p", f"SELECT asset, b AS a, a AS b, corr FROM ({PAIRS}) p",
    *[f"""SELECT asset, '{n}' AS a, '{n}' AS b, CASE WHEN STDDEV_POP("{n}") > 0 THEN 1.0 END AS corr FROM m GROUP BY asset"""
      for n in CORRELATION_METRICS])), ("asset", "a", "b"), ("corr",))
add("correlation_many", BASE, correlations("m", combinations(ALL_NAMES, 2)), ("asset", "a", "b"), ("corr",))
add("correlation_distance", BASE, f"SELECT asset, a, b, ROUND(1 - ABS(corr), 12) AS distance FROM ({PAIRS}) p", ("asset", "a", "b"), ("distance",))
add("top_correlations", BASE, union(
    f"""SELECT asset, a, b, corr, '{side}' AS side, ROW_NUMBER() OVER (PARTITION BY asset ORDER BY corr {order}, pair) AS rank
        FROM ({PAIRS}) p WHERE corr IS NOT NULL""" for side, order in (("highest", "DESC"), ("lowest", "ASC"))),
    ("asset", "a", "b", "side"), ("corr",), ("rank",), where="rank <= 5")
NUMBERS = ("mean", "std", "min", "p25", "p50", "p75", "max")
add("describe", BASE, describe("base", ("PriceUSD", "TxCnt", "CapMVRVCur")), ("asset", "metric"), NUMBERS, ("count",))
add("dataset_info", BASE, "SELECT asset, COUNT(*) AS n_rows, 21 AS n_columns, MIN(time) AS first_time, MAX(time) AS last_time, SUM(" + " + ".join(
    f'CASE WHEN "{n}" IS NULL THEN 1 ELSE 0 END' for n in ALL_NAMES) + ") AS missing_values FROM m GROUP BY asset",
    ("asset", "first_time", "last_time"), whole=("n_rows", "n_columns", "missing_values"))
add("return_vs_vol", BASE, volatility("PriceUSD", 1, 30), KEY, ("PriceUSD_return1_mean30", "PriceUSD_RV30_return1"),
    where=complete(volatility_names("PriceUSD", 1, 30)))

# --- indicators
add("decentralization", DERIVED, "SELECT * FROM d", KEY, ("decentralization_index", "whale_dominance"))
add("dormancy", DERIVED, "SELECT * FROM d", KEY, ("dormant_180d_pct", "dormant_1yr_pct", "dormant_2yr_pct"))
add("whale_activity", DERIVED, "SELECT * FROM d", KEY, ("whale_activity_change_rate",))
add("dormancy_flow", DERIVED, "SELECT * FROM d", KEY, ("dormancy_flow",))
add("regime_label", DERIVED, REGIME, (*KEY, "regime"), ("whale_activity_change_rate", "dormancy_flow"))
add("regime_segments", DERIVED, runs(REGIME, "regime"), ("asset", "label", "start", "end"), whole=("n_rows",))
add("indicator_correlation", DERIVED, correlations("d", combinations(INDICATORS, 2)), ("asset", "a", "b"), ("corr",))
ZONED = f"""SELECT asset, time, "PriceUSD", "CapMVRVCur", {zone('"CapMVRVCur"')} AS zone FROM base
    WHERE "PriceUSD" IS NOT NULL AND "CapMVRVCur" IS NOT NULL"""
add("mvrv_zone", BASE, ZONED, (*KEY, "zone"), ("PriceUSD", "CapMVRVCur"))
add("mvrv_spans", BASE, linked(ZONED, "zone", "CAST(time - LAG(time) OVER ({w}) AS DOUBLE)"), ("asset", "label", "start", "end"), whole=("n_rows",))
GROWTH = ("AdrBalCnt", *TIERS, "AdrActCnt")
GROWTH_OUT = ("all_growth_pct", *[f"{n}_growth_pct" for n in TIERS], "activity_change_pct")
add("insight_summary", BASE, f"""
    SELECT f.asset, l.time AS as_of, c.time AS most_centralized_time, c.v AS lowest_decentralization,
      {", ".join(f'(l."{n}" / NULLIF(f."{n}", 0) - 1) * 100 AS {out}' for n, out in zip(GROWTH, GROWTH_OUT))},
      k.time AS peak_cap_time, k.v AS peak_cap, z."CapMVRVCur" AS latest_mvrv, z.zone AS latest_zone
    FROM (SELECT *, ROW_NUMBER() OVER ({SERIES}) AS r FROM ({TIER_SQL}) t) f
    JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY asset ORDER BY time DESC) AS r FROM ({TIER_SQL}) t) l
      ON l.asset = f.asset AND l.r = 1
    JOIN (SELECT asset, time, 1 - "SplyAdrTop1Pct" / NULLIF("SplyCur", 0) AS v, ROW_NUMBER() OVER
            (PARTITION BY asset ORDER BY 1 - "SplyAdrTop1Pct" / NULLIF("SplyCur", 0), time) AS r FROM base) c
      ON c.asset = f.asset AND c.r = 1
    JOIN (SELECT asset, time, "CapMrktCurUSD" AS v, ROW_NUMBER() OVER
            (PARTITION BY asset ORDER BY "CapMrktCurUSD" DESC, time) AS r FROM base) k
      ON k.asset = f.asset AND k.r = 1
    JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY asset ORDER BY time DESC) AS r FROM ({ZONED}) y) z
      ON z.asset = f.asset AND z.r = 1
    WHERE f.r = 1""",
    ("asset", "as_of", "most_centralized_time", "peak_cap_time", "latest_zone"),
    ("lowest_decentralization", *GROWTH_OUT, "peak_cap", "latest_mvrv"))

# --- many results of one pass, by the SQL of each
SINGLE_PASS = {
    "fit": ("ols_fit", "''", ("slope", "intercept", "r2", "n")),
    "extremes": ("peak_trough", "''", ("peak_value", "trough_value")),
    "dataset": ("dataset_info", "''", ("n_rows", "n_columns", "missing_values")),
    "zeros": ("dq_zero_null", "metric", ("total_records", "zero_count")),
    "nulls": ("dq_null_counts", "metric", ("null_count",)),
    "nonpositive": ("dq_nonpositive", "metric", ("nonpositive_count",)),
    "rules": ("dq_consistency", "rule", ("violations",)),
    "latest": ("latest_summary", "''", ("AdrBalCnt", "AdrBalUSD100KCnt", "AdrBalUSD1MCnt")),
    "tiers": ("tier_distribution", "tier", ("holders", "share_pct")),
    "insights": ("insight_summary", "''", ("lowest_decentralization", "all_growth_pct", "peak_cap", "latest_mvrv", "activity_change_pct")),
}
add("single_pass_figures", BASE, union([
    *[f"""SELECT asset, '{result}' AS result, {item} AS item, '{n}' AS figure, CAST("{n}" AS DOUBLE) AS value FROM ({ORACLES[name]}) s"""
      for result, (name, item, figures) in SINGLE_PASS.items() for n in figures],
    f"SELECT asset, 'correlations', a || ' ' || b, 'corr', corr FROM ({PAIRS}) p"]),
    ("asset", "result", "item", "figure"), ("value",))

# --- raw events
VAL = ("Val", "Val_MA7days", "Val_MA30days", "Val_MA90days")
add("events_moving_average", EVENTS, moving("Val", (7, 30, 90), "e"), KEY, VAL)
add("events_rolling_volatility", EVENTS, volatility("Val", 1, 30, "e"), KEY, volatility_names("Val", 1, 30), where=complete(volatility_names("Val", 1, 30)))
AHEAD = f"({SERIES} ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)"
add("appended_features", EVENTS, f"""SELECT asset, time, "Val", "Val_delta_30d", AVG("Val") OVER {rows(7)} AS "Val_MA7days", AVG("Val") OVER {rows(30)} AS "Val_MA30days",
    CASE WHEN COUNT("Val_delta_30d") OVER {AHEAD} = 7 THEN AVG("Val_delta_30d") OVER {AHEAD} END AS "Val_delta_30d_mean7"
    FROM (SELECT *, "Val" - LAG("Val", 30) OVER ({SERIES}) AS "Val_delta_30d" FROM e) d""",
    KEY, ("Val", "Val_MA7days", "Val_MA30days", "Val_delta_30d", "Val_delta_30d_mean7"))
add("events_long_average", EVENTS, moving("Val", (30, 1000), "e"), KEY, ("Val", "Val_MA30days", "Val_MA1000days"))
add("events_long_volatility", EVENTS, volatility("Val", 1, 500, "e"), KEY, volatility_names("Val", 1, 500), where=complete(volatility_names("Val", 1, 500)))
add("chained_clean_average", DIRTY, moving("v", (7, 30), f"({newest(interpolated('fin', 'v', 'time, seq'))}) cleaned"), KEY, ("v", "v_MA7days", "v_MA30days"))
add("chained_volatility_band", EVENTS, runs(f"""SELECT *, {zone('"Val" / 30')} AS zone FROM ({volatility("Val", 1, 30, "e").replace(
    'SELECT asset, time,', 'SELECT asset, time, event_id,', 1)}) v WHERE {complete(volatility_names("Val", 1, 30))}""", "zone"),
    ("asset", "label", "start", "end"), whole=("n_rows",))
add("events_rolling_delta", EVENTS, delta("Val", 30, "e"), KEY, ("Val_delta_30d", "Val_pct_change_30d"))
add("events_delta_ma_strict", EVENTS, strict_mean("Val", "e"), KEY, ("Val_delta_30d", "Val_delta_30d_mean7"))
add("events_growth_from_base", EVENTS, growth(("Val",), "SELECT * FROM e"), KEY, ("Val_growth_pct",))
add("events_interpolate", EVENTS + """,
n AS (SELECT asset, time, event_id, CASE WHEN "Val" >= 20 THEN "Val" END AS "Val" FROM e)""", interpolated("n", "Val", "time"), KEY, ("Val",))
add("events_gaps", EVENTS, steps("e", HOUR_DAYS), ("asset", "gap_start", "gap_end"), ("days_gap",), where="days_gap > 1.0 / 48")
HOUR = "1.0 / 24 + 1e-9"
add("hours_gaps", HOURS, steps("m", HOUR_DAYS), ("asset", "gap_start", "gap_end"), ("days_gap",), where=f"days_gap > {HOUR}")
add("hours_flat_runs", HOURS, union(flat(n, 2) for n in ("EvtCnt", "Users")), ("asset", "time", "metric"), ("value",), ("unchanged_count",), where="unchanged_count = 2")
add("hours_report", HOURS, report(("EvtCnt", "Users", "Val"), 2, HOUR, "m", HOUR_DAYS), ("asset", "feature"),
    whole=("total_records", "gap_count", "zero_count", "repeated_values_count"))
FLAT_SPANS = union(f"""SELECT asset, '{n}' AS metric, label AS value, "start", "end", n_rows FROM ({runs('SELECT * FROM m', n)}) r WHERE n_rows > 1"""
    for n in ("EvtCnt", "Users", "Val"))
add("hours_flat_spans", HOURS, FLAT_SPANS, ("asset", "metric", "start", "end"), ("value",), ("n_rows",), where="metric <> 'Val'")
ISSUES = f"""SELECT asset, NULL AS feature, 'gap' AS issue, gap_start AS "start", gap_end AS "end", days_gap AS size FROM ({steps("m", HOUR_DAYS)}) g WHERE days_gap > {HOUR}
    UNION ALL SELECT asset, metric, 'flat', "start", "end", n_rows FROM ({FLAT_SPANS}) f"""
add("hours_largest_issues", HOURS, f"""SELECT *, ROW_NUMBER() OVER (PARTITION BY asset, feature, issue ORDER BY size DESC, "start", "end") AS rank FROM ({ISSUES}) i""",
    ("asset", "feature", "issue", "start", "end"), ("size",), ("rank",), where="rank <= 5")
add("sketched_percentiles", EVENTS + """,
days AS (SELECT day, ROW_NUMBER() OVER (ORDER BY day) - 1 AS place, COUNT(*) OVER () AS n
    FROM (SELECT DISTINCT CAST(time AS DATE) AS day FROM e WHERE "Val" IS NOT NULL) d)""",
    """SELECT asset, COUNT("Val") AS n, true AS q10_held, true AS q25_held, true AS q50_held, true AS q75_held, true AS q90_held
    FROM e WHERE CAST(time AS DATE) BETWEEN (SELECT day FROM days WHERE place = n // 4) AND (SELECT day FROM days WHERE place = n // 4 * 3) GROUP BY asset""",
    ("asset",), whole=("n",), plain=("q10_held", "q25_held", "q50_held", "q75_held", "q90_held"))
add("events_percentiles", EVENTS, quantiles("SELECT * FROM e", "Val"), ("asset",), ("q10", "q25", "q50", "q75", "q90"))
add("events_value_band", EVENTS, bands("SELECT * FROM e", "Val"), ("asset", "time", "band"), ("Val",))
add("events_mean_median", EVENTS, 'SELECT asset, AVG("Val") AS mean, MEDIAN("Val") AS median FROM e GROUP BY asset', ("asset",), ("mean", "median"))
add("events_describe", EVENTS, describe("e", ("Val",)), ("asset", "metric"), NUMBERS, ("count",))
add("events_histogram", EVENTS, histogram("e", "Val"), ("asset",), ("bin_start", "density"), ("bin", "n"))
add("events_kde_grid", EVENTS, density("e", "Val"), ("asset",), ("x", "density"), ("point",))
add("events_peak_trough", EVENTS, extremes("e", "Val"), ("asset", "peak_time", "trough_time"), ("peak_value", "trough_value"))
SIGNS = f"""SELECT *, CASE WHEN "Val_delta_1d" > 0 THEN 'positive' ELSE 'negative' END AS delta_class FROM ({delta("Val", 1, "e")}) g"""
add("events_sign_segments", EVENTS, runs(SIGNS, "delta_class"), ("asset", "label", "start", "end"), whole=("n_rows",))
add("events_zone_spans", EVENTS, linked(f"""SELECT *, {zone('"Val" / 30')} AS zone FROM e""", "zone",
    "CAST(epoch_us(time) - epoch_us(LAG(time) OVER ({w})) AS DOUBLE) / 86400000000.0"), ("asset", "label", "start", "end"), whole=("n_rows",))

# --- the same results from series cut into many chunks
for part in ("moving_average", "rolling_volatility", "rolling_delta", "delta_ma_strict", "gaps", "interpolate", "sign_segments"):
    ORACLES[f"chunked_{part}"] = ORACLES[f"events_{part}"]
ORACLES["chunked_flat_runs"] = ORACLES["hours_flat_runs"]
