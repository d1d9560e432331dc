"""Oracle SQL (DuckDB) of the queries that SQL can express."""

from __future__ import annotations

BASE = """
b AS (SELECT event_type AS fixture, CAST(floor(epoch(ts) / 600) AS BIGINT) AS k, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) AS flow FROM events GROUP BY 1, 2),
r AS (SELECT min(k) AS k0, max(k) AS k1 FROM b),
f AS (SELECT * FROM (VALUES (0, 'click', 'browse', 8000.0::DOUBLE), (1, 'error', 'fault', 7000.0), (2, 'purchase', 'commit', 8400.0), (3, 'signup', 'commit', 9000.0), (4, 'view', 'browse', 8100.0)) AS t(ord, fixture, category, rate)),
s AS (SELECT f.fixture, g.k - r.k0 AS idx, make_timestamp(g.k * 600000000) AS ts, coalesce(b.flow, 0)::DOUBLE AS flow, b.flow IS NOT NULL AS valid
      FROM f CROSS JOIN r CROSS JOIN LATERAL (SELECT unnest(range(r.k0, r.k1 + 1)) AS k) g LEFT JOIN b ON b.fixture = f.fixture AND b.k = g.k),
tot AS (SELECT idx, ts, sum(flow) AS flow, bool_or(valid) AS valid FROM s GROUP BY 1, 2)"""


def chain(name: str, source: str, on: str, off: str, gap: int = 2, least: int = 2, key: str = "fixture", valid: bool = True) -> str:
    """CTEs <name>h (active), <name>u (runs), <name>g (bridged) and <name> (events)."""
    masked = " AND valid" if valid else ""
    return f"""
{name}h AS (SELECT *, coalesce(last_value(CASE WHEN flow > {on} THEN 1 WHEN flow < {off} THEN 0 END IGNORE NULLS) OVER (PARTITION BY {key} ORDER BY idx ROWS UNBOUNDED PRECEDING), 0) = 1 AS on_ FROM {source}),
{name}u AS (SELECT {key}, min(idx) AS start_idx, max(idx) + 1 AS end_idx FROM (SELECT *, idx - row_number() OVER (PARTITION BY {key} ORDER BY idx) AS g FROM {name}h WHERE on_{masked}) GROUP BY {key}, g),
{name}g AS (SELECT {key}, min(start_idx) AS start_idx, max(end_idx) AS end_idx, count(*) AS n_runs FROM (SELECT *, sum(o) OVER (PARTITION BY {key} ORDER BY start_idx ROWS UNBOUNDED PRECEDING) AS g FROM
  (SELECT *, CASE WHEN start_idx - lag(end_idx) OVER (PARTITION BY {key} ORDER BY start_idx) <= {gap} THEN 0 ELSE 1 END AS o FROM {name}u)) GROUP BY {key}, g),
{name} AS (SELECT * FROM {name}g WHERE end_idx - start_idx >= {least})"""


A = chain("a", "s", "5000", "2500")
B = chain("c", "s", "8000", "4000")
STATS = """
st AS (SELECT a.fixture, a.start_idx, a.end_idx, any_value(a.n_runs) AS n_runs, count(*) AS n, avg(s.flow) AS mean, max(s.flow) AS peak, sum(s.flow) * 600 / 60 AS volume
       FROM a JOIN s ON s.fixture = a.fixture AND s.idx >= a.start_idx AND s.idx < a.end_idx GROUP BY 1, 2, 3)"""
PRED = """
p AS (SELECT s.fixture, s.idx, s.ts, CASE WHEN a.fixture IS NOT NULL THEN s.flow ELSE 0 END AS flow, s.valid FROM s LEFT JOIN a ON s.fixture = a.fixture AND s.idx >= a.start_idx AND s.idx < a.end_idx)"""
LAB = """
l AS (SELECT s.fixture, s.idx, s.ts, CASE WHEN c.fixture IS NOT NULL THEN s.flow ELSE 0 END AS flow, s.valid FROM s LEFT JOIN c ON s.fixture = c.fixture AND s.idx >= c.start_idx AND s.idx < c.end_idx)"""
BOTH = "bo AS (SELECT p.fixture, p.idx, p.ts, p.flow AS p, l.flow AS t FROM p JOIN l USING (fixture, idx))"
PAIRS = """
pr AS (SELECT a.fixture, a.start_idx AS l_start_idx, a.end_idx AS l_end_idx, c.start_idx AS r_start_idx, c.end_idx AS r_end_idx,
              least(a.end_idx, c.end_idx) - greatest(a.start_idx, c.start_idx) AS inter
       FROM a JOIN c ON a.fixture = c.fixture AND a.start_idx < c.end_idx AND c.start_idx < a.end_idx),
io AS (SELECT *, inter / ((l_end_idx - l_start_idx) + (r_end_idx - r_start_idx) - inter) AS iou FROM pr)"""
COUNTS = """
mc AS (SELECT f.fixture, coalesce(m.tp, 0)::BIGINT AS tp, (coalesce(x.n, 0) - coalesce(m.tp, 0))::BIGINT AS fp, (coalesce(y.n, 0) - coalesce(m.tp, 0))::BIGINT AS fn, coalesce(y.n, 0)::BIGINT AS n_labelled, m.median_iou
       FROM (SELECT fixture FROM a UNION SELECT fixture FROM c) f LEFT JOIN (SELECT fixture, count(*) AS n FROM a GROUP BY 1) x USING (fixture) LEFT JOIN (SELECT fixture, count(*) AS n FROM c GROUP BY 1) y USING (fixture)
       LEFT JOIN (SELECT fixture, count(*) AS tp, median(iou) AS median_iou FROM io WHERE iou >= 0.6 GROUP BY 1) m USING (fixture))"""
WIN = """
wi AS (SELECT w.start, min(t.ts) AS ts, count(*) AS n, min(CAST(t.ts AS DATE)) AS first_day, max(CAST(t.ts AS DATE)) AS last_day, bool_or(t.flow > 30000) AS any_active
       FROM (SELECT unnest(range(0, (SELECT max(idx) FROM tot) + 1, 3)) AS start) w JOIN tot t ON t.idx >= w.start AND t.idx < w.start + 12 GROUP BY 1 HAVING count(*) = 12)"""
ENT = """
di AS (SELECT event_id AS entry, CAST(floor(floor(epoch(ts)) / 60) AS BIGINT) * 60 AS start_idx, CAST(user_id % 3 AS VARCHAR) AS fixture FROM events WHERE event_type = 'signup' AND user_id % 10 <> 0),
ca AS (SELECT event_id AS candidate, CAST(floor(epoch(ts)) AS BIGINT) AS start_idx FROM events WHERE event_type = 'purchase'),
ne AS (SELECT entry, candidate, offset_s, count(*) OVER (PARTITION BY candidate) > 1 AS shared_candidate FROM
       (SELECT di.entry, ca.candidate, di.start_idx - ca.start_idx AS offset_s, row_number() OVER (PARTITION BY entry ORDER BY abs(di.start_idx - ca.start_idx), candidate) AS n FROM di JOIN ca ON abs(di.start_idx - ca.start_idx) <= 300) WHERE n = 1)"""


def sql(*parts: str) -> str:
    *ctes, body = parts
    return "WITH " + ",".join(ctes) + "\n" + body


def search(body: str) -> str:
    grid = "gs AS (SELECT s.*, x.frac, f.rate FROM s JOIN f USING (fixture) CROSS JOIN (VALUES (0.5::DOUBLE), (0.75), (1.0), (1.25)) AS x(frac))"
    found = chain("q", "gs", "rate * frac", "rate * frac * 0.5", 2, 2, "fixture, frac")
    tail = """
tp AS (SELECT q.fixture, q.frac, count(*) AS tp FROM q JOIN c ON q.fixture = c.fixture AND q.start_idx < c.end_idx AND c.start_idx < q.end_idx
       AND (least(q.end_idx, c.end_idx) - greatest(q.start_idx, c.start_idx)) / ((q.end_idx - q.start_idx) + (c.end_idx - c.start_idx) - (least(q.end_idx, c.end_idx) - greatest(q.start_idx, c.start_idx))) >= 0.6 GROUP BY 1, 2),
ta AS (SELECT t.fixture, t.frac, coalesce(tp.tp, 0)::BIGINT AS tp, coalesce(n.n, 0)::BIGINT AS n_pred, t.n_labelled, 2 * coalesce(tp.tp, 0) / (coalesce(n.n, 0) + t.n_labelled) AS f1
       FROM (SELECT fixture, frac, count(*) AS n_labelled FROM c CROSS JOIN (VALUES (0.5::DOUBLE), (0.75), (1.0), (1.25)) AS x(frac) GROUP BY 1, 2) t
       LEFT JOIN (SELECT fixture, frac, count(*) AS n FROM q GROUP BY 1, 2) n USING (fixture, frac) LEFT JOIN tp USING (fixture, frac))"""
    return sql(BASE, B, grid, found, tail, body)


LOOKUP = """
lk AS (SELECT substr(event_type, 1, 2) AS page, CASE WHEN user_id % 7 = 0 THEN 'X' ELSE upper(substr(event_type, -1, 1)) END AS symbol FROM events),
lo AS (SELECT lk.*, f.fixture FROM lk LEFT JOIN f ON lk.page = substr(f.fixture, 1, 2) AND lk.symbol = upper(substr(f.fixture, -1, 1)))"""

ORACLE = {
    "regularise": sql(BASE, "SELECT fixture, idx, ts, flow, valid FROM s"),
    "regularise_users": """WITH e AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS sec, round(value * 100) AS flow FROM events), r AS (SELECT min(sec) AS s0, max(sec) AS s1 FROM e),
g AS (SELECT unnest(range(s0, s1 + 1, 60)) AS sec FROM r), o AS (SELECT sec, avg(flow) AS flow FROM e GROUP BY 1)
SELECT CAST(make_timestamp(g.sec * 1000000) AS DATE) AS day, count(*) AS samples, count(o.sec) AS observed, sum(coalesce(o.flow, 0)) AS flow FROM g LEFT JOIN o USING (sec) GROUP BY 1""",
    "deadband": sql(BASE, "SELECT fixture, sum(CASE WHEN abs(flow) < 2500 THEN 0 ELSE greatest(flow, 0) END) AS flow, count(*) FILTER (WHERE flow >= 2500) AS above FROM s GROUP BY 1"),
    "trace_volume": sql(BASE, "SELECT sum(CASE WHEN valid AND flow >= 2500 THEN flow ELSE 0 END) * 600 / 60 AS volume FROM tot"),
    "trace_summary": sql(BASE, 'SELECT min(ts) AS start, max(ts) AS "end", count(*) AS samples, count(*) FILTER (WHERE valid) AS observed, count(*) FILTER (WHERE NOT valid) AS missing, count(DISTINCT CAST(ts AS DATE)) AS days, sum(CASE WHEN valid AND flow >= 2500 THEN flow ELSE 0 END) * 600 / 60 AS volume, max(CASE WHEN valid THEN CASE WHEN flow < 2500 THEN 0 ELSE flow END END) AS peak, count(*) FILTER (WHERE NOT valid) / count(*) AS missing_frac FROM tot'),
    "null_skipping_merge": "SELECT date_trunc('hour', ts) AS ts, avg(CASE WHEN user_id % 2 = 0 THEN round(value * 100) END) AS even, avg(CASE WHEN user_id % 2 = 1 THEN round(value * 100) END) AS odd FROM events GROUP BY 1",
    "mean_of_means": "SELECT ts, avg(flow) AS flow FROM (SELECT date_trunc('hour', ts) AS ts, user_id % 2 AS source, avg(round(value * 100)) AS flow FROM events GROUP BY 1, 2) GROUP BY 1",
    "tz_shift_days": "SELECT CAST(ts - INTERVAL 5 HOUR AS DATE) AS day, count(*) AS n FROM events GROUP BY 1",
    "one_day": sql(BASE, "SELECT fixture, count(*) AS n, sum(flow) AS flow FROM s WHERE CAST(ts AS DATE) = DATE '2024-01-10' GROUP BY 1"),
    "local_days": sql(BASE, "SELECT DISTINCT CAST(ts AS DATE) AS day FROM s"),
    "hysteresis": sql(BASE, A, "SELECT fixture, idx, on_ AS active FROM ah"),
    "runs": sql(BASE, A, "SELECT * FROM au"),
    "bridge": sql(BASE, A, "SELECT * FROM ag"),
    "segment_events": sql(BASE, A, STATS, "SELECT * FROM st"),
    "segment_total": sql(BASE, "d AS (SELECT 'all' AS fixture, idx, CASE WHEN flow < 2500 THEN 0 ELSE flow END AS flow, valid FROM tot)", chain("q", "d", "20000", "10000", 1, 2), "SELECT start_idx, end_idx FROM q"),
    "events_from_matrix": sql(BASE, A, PRED, chain("q", "p", "5000", "2500", 2, 2, valid=False), "SELECT fixture, start_idx, end_idx FROM q"),
    "plateau": sql(BASE, A, """x AS (SELECT a.fixture, a.start_idx, a.end_idx, s.flow, row_number() OVER (PARTITION BY a.fixture, a.start_idx ORDER BY s.idx) - 1 AS i, count(*) OVER (PARTITION BY a.fixture, a.start_idx) AS n
FROM a JOIN s ON s.fixture = a.fixture AND s.idx >= a.start_idx AND s.idx < a.end_idx),
y AS (SELECT *, n >= 6 AND i >= floor(n * 0.3::DOUBLE) AND i < greatest(floor(n * 0.85::DOUBLE), floor(n * 0.3::DOUBLE) + 1) AS kept FROM x)""", "SELECT fixture, start_idx, end_idx, CASE WHEN count(*) FILTER (WHERE kept) >= 3 THEN median(flow) FILTER (WHERE kept) END AS plateau FROM y GROUP BY 1, 2, 3"),
    "event_enrich": sql(BASE, A, """x AS (SELECT a.*, make_timestamp((k0 + start_idx) * 600000000) AS "start", make_timestamp((k0 + end_idx) * 600000000) AS "end" FROM a CROSS JOIN r)""",
        """SELECT fixture, start_idx, "start", "end", CAST(CAST("start" AS DATE) AS VARCHAR) AS date, hour("start") + minute("start") / 60.0::DOUBLE + second("start") / 3600.0::DOUBLE AS time_of_day_h, CASE WHEN isodow("start") >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, (end_idx - start_idx) * 600 AS duration_s, ((end_idx - start_idx) * 600) / 60.0::DOUBLE AS duration_min FROM x"""),
    "isolated_events": sql(BASE, A, "SELECT fixture, start_idx, end_idx FROM a x WHERE NOT EXISTS (SELECT 1 FROM a y WHERE y.fixture <> x.fixture AND y.start_idx < x.end_idx AND x.start_idx < y.end_idx)"),
    "fit_rates": sql(BASE, A, """z AS (SELECT fixture, start_idx, end_idx FROM a x WHERE NOT EXISTS (SELECT 1 FROM a y WHERE y.fixture <> x.fixture AND y.start_idx < x.end_idx AND x.start_idx < y.end_idx)),
x AS (SELECT z.*, CASE WHEN t.flow < 2500 THEN 0 ELSE t.flow END AS flow, row_number() OVER (PARTITION BY z.fixture, z.start_idx ORDER BY t.idx) - 1 AS i, count(*) OVER (PARTITION BY z.fixture, z.start_idx) AS n FROM z JOIN tot t ON t.idx >= z.start_idx AND t.idx <= z.end_idx),
y AS (SELECT *, n >= 6 AND i >= floor(n * 0.3::DOUBLE) AND i < greatest(floor(n * 0.85::DOUBLE), floor(n * 0.3::DOUBLE) + 1) AS kept FROM x),
pl AS (SELECT fixture, start_idx, CASE WHEN count(*) FILTER (WHERE kept) >= 3 THEN median(flow) FILTER (WHERE kept) END AS plateau FROM y GROUP BY 1, 2),
ft AS (SELECT fixture, count(*) AS n, median(plateau) AS m, quantile_cont(plateau, 0.75) - quantile_cont(plateau, 0.25) AS q FROM pl WHERE plateau > 0 GROUP BY 1)""",
        "SELECT f.fixture, CASE WHEN ft.n >= 3 THEN ft.m ELSE f.rate END AS rate, coalesce(ft.n, 0)::BIGINT AS n_isolated, CASE WHEN ft.n >= 3 THEN ft.q END AS iqr, CASE WHEN ft.n >= 3 THEN 'fitted' ELSE 'configured' END AS note FROM f LEFT JOIN ft USING (fixture)"),
    "separability": sql(BASE, "SELECT x.fixture AS first, y.fixture AS second, abs(x.rate - y.rate) / greatest(x.rate, y.rate) AS gap, abs(x.rate - y.rate) / greatest(x.rate, y.rate) < 0.08 AS at_risk FROM f x JOIN f y ON x.fixture < y.fixture"),
    "thresholds": sql(BASE, 'SELECT fixture, rate * 0.5::DOUBLE AS "on", rate * 0.25::DOUBLE AS "off", 2 AS min_samples, 2 AS max_gap FROM f'),
    "assemble_events": sql(BASE, "sf AS (SELECT s.*, f.rate FROM s JOIN f USING (fixture))", chain("a", "sf", "rate * 0.5", "rate * 0.25"), STATS, "SELECT fixture, start_idx, end_idx, n, peak, volume FROM st"),
    "merge_close": sql(BASE, A, STATS, """x AS (SELECT *, CASE WHEN start_idx - lag(end_idx) OVER w < 6 THEN 0 ELSE 1 END AS o FROM st WINDOW w AS (PARTITION BY fixture ORDER BY start_idx)),
y AS (SELECT *, sum(o) OVER (PARTITION BY fixture ORDER BY start_idx ROWS UNBOUNDED PRECEDING) AS g FROM x)""", "SELECT fixture, min(start_idx) AS start_idx, arg_max(end_idx, start_idx) AS end_idx, sum(volume) AS volume, max(peak) AS peak, arg_min(mean, start_idx) AS mean, count(*) AS n_merged FROM y GROUP BY fixture, g"),
    "stagnation": sql(BASE, A, "SELECT * FROM (SELECT fixture, start_idx, (start_idx - lag(end_idx) OVER (PARTITION BY fixture ORDER BY start_idx)) * 600 / 3600.0::DOUBLE AS hours FROM a) WHERE hours IS NOT NULL"),
    "stagnation_summary": sql(BASE, A, "x AS (SELECT * FROM (SELECT fixture, (start_idx - lag(end_idx) OVER (PARTITION BY fixture ORDER BY start_idx)) * 600 / 3600.0::DOUBLE AS hours FROM a) WHERE hours IS NOT NULL)", "SELECT fixture, count(*) AS n, median(hours) AS median_h, count(*) FILTER (WHERE hours < 1) / count(*) AS below_1h FROM x GROUP BY 1"),
    "share_of_measured": sql(BASE, A, STATS, "x AS (SELECT st.fixture, st.start_idx, st.end_idx, sum(t.flow) * 600 / 60 AS total FROM st JOIN tot t ON t.idx >= st.start_idx AND t.idx <= st.end_idx GROUP BY 1, 2, 3)", "SELECT fixture, start_idx, end_idx, CASE WHEN total > 0 THEN volume / total END AS share_of_measured FROM st JOIN x USING (fixture, start_idx, end_idx)"),
    "iou_pairs": sql(BASE, A, B, PAIRS, "SELECT * FROM io"),
    "match_counts": sql(BASE, A, B, PAIRS, COUNTS, "SELECT fixture, tp, fp, fn, n_labelled FROM mc"),
    "event_metrics": sql(BASE, A, B, PAIRS, COUNTS, "x AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall FROM mc)", "SELECT *, coalesce(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END, 0) AS f1 FROM x"),
    "threshold_search": search("SELECT * FROM ta"),
    "threshold_best": search("SELECT fixture, frac, f1 FROM ta QUALIFY row_number() OVER (PARTITION BY fixture ORDER BY f1 DESC, frac) = 1"),
    "daily_volume": sql(BASE, A, PRED, "SELECT fixture, CAST(ts AS DATE) AS day, sum(flow) * 600 / 60 AS volume FROM p GROUP BY 1, 2"),
    "volume_by_fixture": sql(BASE, A, PRED, "SELECT fixture, count(*) AS samples, count(*) FILTER (WHERE flow > 2500) AS active, sum(flow) * 600 / 60 AS volume FROM p GROUP BY 1"),
    "volume_mae": sql(BASE, A, B, PRED, LAB, BOTH, "x AS (SELECT fixture, CAST(ts AS DATE) AS day, sum(p) * 600 / 60 AS p, sum(t) * 600 / 60 AS t FROM bo GROUP BY 1, 2)", "SELECT fixture, avg(abs(p - t)) AS mae, avg(p - t) AS bias, count(*) AS n_days FROM x GROUP BY 1"),
    "sample_mae": sql(BASE, A, B, PRED, LAB, BOTH, "x AS (SELECT *, sum(t) OVER (PARTITION BY idx) AS total FROM bo)", "SELECT fixture, avg(abs(p - t)) AS mae, avg(CASE WHEN t > 2500 THEN abs(p - t) END) AS mae_active, count(*) FILTER (WHERE t > 2500) AS n_active FROM x WHERE total > 2500 GROUP BY 1"),
    "confusion": sql(BASE, A, B, PRED, LAB, BOTH, """x AS (SELECT idx, count(*) FILTER (WHERE t > 2500) AS n, max(fixture) FILTER (WHERE t > 2500) AS "true", first(fixture ORDER BY p DESC, ord) AS predicted FROM bo JOIN f USING (fixture) GROUP BY 1 HAVING count(*) FILTER (WHERE t > 2500) = 1),
y AS (SELECT "true", predicted, count(*) AS n FROM x GROUP BY 1, 2),
z AS (SELECT u.fixture AS "true", v.fixture AS predicted, coalesce(y.n, 0) AS n FROM f u CROSS JOIN f v LEFT JOIN y ON y."true" = u.fixture AND y.predicted = v.fixture)""", 'SELECT "true", predicted, CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w ELSE 0 END AS share FROM z WINDOW w AS (PARTITION BY "true")'),
    "concurrency": sql(BASE, A, PRED, "x AS (SELECT ts, count(DISTINCT fixture) AS n_active FROM p WHERE flow > 2500 GROUP BY 1)", "SELECT n_active, count(*) AS samples, count(*) / sum(count(*)) OVER () AS share FROM x GROUP BY 1"),
    "active_mask": sql(BASE, A, PRED, "SELECT active, count(*) AS n FROM (SELECT idx, bool_or(flow > 2500) AS active FROM p GROUP BY 1) GROUP BY 1"),
    "labelled_days": sql(BASE, A, PRED, "SELECT DISTINCT CAST(ts AS DATE) AS day FROM p WHERE flow > 12000"),
    "proportional_labels": sql(BASE, A, "x AS (SELECT DISTINCT a.fixture, t.idx, t.flow, f.rate FROM a JOIN tot t ON t.idx >= a.start_idx AND t.idx < a.end_idx JOIN f ON f.fixture = a.fixture)", "SELECT fixture, idx, greatest(flow, 0) * rate / sum(rate) OVER (PARTITION BY idx) AS flow FROM x"),
    "label_pivot": sql(BASE, A, PRED, "SELECT idx, " + ", ".join(f"sum(flow) FILTER (WHERE fixture = '{c}') AS {c}" for c in ("click", "error", "purchase", "signup", "view")) + " FROM p GROUP BY 1"),
    "window_counts": sql(BASE, WIN, "SELECT first_day, count(*) AS n, min(start) AS first_start, max(start) AS last_start FROM wi WHERE first_day = last_day GROUP BY 1"),
    "window_activity": sql(BASE, WIN, "SELECT start, ts, any_active FROM wi WHERE any_active"),
    "window_arrays": sql(BASE, "SELECT w.start, arg_min(t.flow, t.idx) AS x_first, arg_max(t.flow, t.idx) AS x_last, sum(t.flow) AS x_sum, CAST(count(*) FILTER (WHERE t.valid) AS INTEGER) AS n_valid FROM (SELECT unnest(range(0, (SELECT max(idx) FROM tot) + 1, 6)) AS start) w JOIN tot t ON t.idx >= w.start AND t.idx < w.start + 12 GROUP BY 1 HAVING count(*) = 12"),
    "window_event_counts": sql(BASE, A, PRED, WIN, "SELECT p.fixture, count(DISTINCT wi.start) AS n_windows FROM p JOIN wi ON p.idx >= wi.start AND p.idx < wi.start + 12 WHERE p.flow > 2500 GROUP BY 1"),
    "tile_owner": sql(BASE, "n AS (SELECT count(*) AS n FROM tot), x AS (SELECT idx, CAST(floor((idx - 22) / 15) AS BIGINT) * 15 AS o FROM tot)", "SELECT idx, CASE WHEN o >= 0 AND o + 60 <= n THEN o ELSE -1 END AS owner, CASE WHEN o >= 0 AND o + 60 <= n THEN idx - o ELSE -1 END AS position FROM x CROSS JOIN n"),
    "partition_sizes": sql(BASE, "x AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM s)", "SELECT CASE WHEN isodow(day) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, count(*) AS n, CAST(min(day) AS VARCHAR) AS first FROM x GROUP BY 1"),
    "reconciliation": sql(BASE, A, PRED, "x AS (SELECT sum(p.flow) / any_value(t.flow) AS r FROM p JOIN tot t USING (idx) WHERE t.flow > 2500 GROUP BY idx)", "SELECT count(*) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS std, min(r) AS min, quantile_cont(r, 0.25) AS p25, quantile_cont(r, 0.5) AS p50, quantile_cont(r, 0.75) AS p75, max(r) AS max FROM x"),
    "rate_allocation": sql(BASE, "SELECT 5::BIGINT AS n, count(*) AS samples, count(*) AS whole FROM tot"),
    "nearest_match": sql(ENT, "SELECT * FROM ne"),
    "match_report": sql(ENT, "SELECT fixture, count(*) AS n_rows, count(offset_s) AS n_matched, count(offset_s) / count(*) AS match_rate, median(offset_s) AS median_offset FROM di LEFT JOIN ne USING (entry) GROUP BY 1"),
    "orphan_candidates": sql(ENT, "SELECT candidate FROM ca WHERE candidate NOT IN (SELECT candidate FROM ne)"),
    "diary_parse": "SELECT event_id, date_trunc('second', ts) AS start FROM events",
    "diary_lookup": sql(BASE, LOOKUP, "SELECT fixture, page, symbol, count(*) AS n FROM lo GROUP BY 1, 2, 3"),
    "unknown_codes": sql(BASE, LOOKUP, "SELECT page, symbol, count(*) AS n FROM lo WHERE fixture IS NULL GROUP BY 1, 2"),
    "iir_response": "WITH RECURSIVE " + ",".join([BASE, """
x AS (SELECT fixture, CAST(ts AS DATE) AS day, flow, row_number() OVER (PARTITION BY fixture, CAST(ts AS DATE) ORDER BY idx) - 1 AS i FROM s),
z AS (SELECT fixture, day, i, flow AS y FROM x WHERE i = 0 UNION ALL
      SELECT x.fixture, x.day, x.i, z.y + 0.5::DOUBLE * (x.flow - z.y) FROM z JOIN x ON x.fixture = z.fixture AND x.day = z.day AND x.i = z.i + 1)"""]) + "\nSELECT fixture, day, arg_max(y, i) AS y FROM z GROUP BY 1, 2",
}

PARTS = """
dp AS (SELECT day, CASE WHEN day(day) <= 18 THEN 'train' WHEN day(day) <= 22 THEN 'val' WHEN day(day) <= 26 THEN 'test' END AS part FROM (SELECT DISTINCT CAST(ts AS DATE) AS day FROM s))"""
ORACLE |= {
    "part_sizes": """
WITH x AS (SELECT CAST(n AS INTEGER) AS n, fraction, fraction - 0.05::DOUBLE AS vf FROM (SELECT unnest(range(1, 61)) AS n) CROSS JOIN (VALUES (0.2::DOUBLE), (0.35)) AS t(fraction)),
y AS (SELECT *, greatest(round_even(n * fraction, 0), 3) AS t, greatest(round_even(n * vf, 0), 2) AS v FROM x),
z AS (SELECT *, greatest(n // 4, 1) AS t2, greatest(n // 5, 1) AS v2 FROM y)
SELECT n, fraction, CAST(CASE WHEN t + v < n THEN t ELSE t2 END AS INTEGER) AS n_test, CAST(CASE WHEN t + v < n THEN v WHEN t2 + v2 < n THEN v2 ELSE greatest(n - t2 - 1, 0) END AS INTEGER) AS n_val FROM z""",
    "partition_windows": sql(BASE, WIN, PARTS, "SELECT dp.part, wi.first_day, count(*) AS n, min(wi.start) AS first_start, max(wi.start) AS last_start FROM wi JOIN dp ON dp.day = wi.first_day WHERE wi.first_day = wi.last_day AND dp.part IS NOT NULL GROUP BY 1, 2"),
    "partition_table": sql(BASE, PARTS, "SELECT part, count(*) AS n_days, count(*) FILTER (WHERE isodow(day) >= 6) AS n_weekend, CAST(min(day) AS VARCHAR) AS first, CAST(max(day) AS VARCHAR) AS last FROM dp WHERE part IS NOT NULL GROUP BY 1"),
    "window_totals": sql(BASE, WIN, "SELECT count(*) AS n_windows, count(*) FILTER (WHERE any_active) AS n_active, min(start) AS first, max(start) AS last, count(DISTINCT first_day) AS n_days FROM wi WHERE any_active"),
    "window_thin_support": f"SELECT f.fixture, coalesce(x.n_windows, 0)::BIGINT AS n_windows FROM (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view')) AS f(fixture) LEFT JOIN ({ORACLE['window_event_counts']}) x USING (fixture) WHERE coalesce(x.n_windows, 0) < 1000",
    "threshold_report": search("""SELECT * FROM (WITH be AS (SELECT fixture, frac, f1 FROM ta WHERE fixture <> 'view' QUALIFY row_number() OVER (PARTITION BY fixture ORDER BY f1 DESC, frac) = 1)
SELECT f.fixture, round(f.rate, 3) AS rate, round(f.rate * coalesce(be.frac, 0.5), 3) AS "on", round(coalesce(be.frac, 0.5), 3) AS frac, round(be.f1, 3) AS f1,
       CASE WHEN be.frac IS NULL THEN 'no labelled events: configured fraction' ELSE '' END AS note FROM f LEFT JOIN be USING (fixture))"""),
    "rate_report": f"SELECT fixture, round(rate, 3) AS rate, n_isolated, round(iqr, 3) AS iqr, note FROM ({ORACLE['fit_rates']})",
    "plain_rates": sql(BASE, "SELECT fixture, coalesce(greatest(median(flow) FILTER (WHERE flow > 2500), 0.1::DOUBLE), 1.0::DOUBLE) AS rate FROM s GROUP BY 1"),
}

#: Queries whose dates are shown as text, with the column.
DATED = {
    "partition_windows": "first_day",
    "regularise_users": "day",
    "tz_shift_days": "day",
    "local_days": "day",
    "daily_volume": "day",
    "labelled_days": "day",
    "window_counts": "first_day",
    "iir_response": "day",
}
ORACLE |= {name: f"SELECT * REPLACE (CAST({c} AS VARCHAR) AS {c}) FROM ({ORACLE[name]})" for name, c in DATED.items()}
