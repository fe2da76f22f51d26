"""SQL building blocks for what one plain query can't say: elimination, greedy steps, peaks, autoregression.

Each function returns common table expressions for DuckDB, to be put after ``WITH RECURSIVE``.
"""

from __future__ import annotations


def gram(source: str, name: str = "g") -> str:
    """``name`` (port, m): normal equations of ``source`` (port, ts, c), where c lists a row's columns, the target last."""
    return f"""{name}_col AS (SELECT port, j, list(c[j] ORDER BY ts) AS v, min(len(c)) AS size FROM {source}, LATERAL (SELECT unnest(range(1, len(c) + 1)) AS j) AS u GROUP BY port, j),
{name}_row AS (SELECT a.port, a.j AS i, list(list_dot_product(a.v, b.v) ORDER BY b.j) AS r FROM {name}_col a JOIN {name}_col b ON a.port = b.port WHERE a.j < a.size GROUP BY a.port, a.j),
{name} AS (SELECT port, list(r ORDER BY i) AS m FROM {name}_row GROUP BY port)"""


def eliminated(system: str, name: str = "x") -> str:
    """``name`` (port, w): solutions of ``system`` (port, m) by elimination, column by column."""
    return f"""{name}_step AS (SELECT port, 0 AS k, m FROM {system} UNION ALL
  SELECT port, k + 1, list_transform(m, lambda row, i: CASE WHEN i = k + 1 THEN list_transform(row, lambda v: v / row[k + 1]) ELSE list_transform(row, lambda v, j: v - row[k + 1] * m[k + 1][j] / m[k + 1][k + 1]) END) FROM {name}_step WHERE k < len(m)),
{name} AS (SELECT port, list_transform(m, lambda row: row[-1]) AS w FROM {name}_step WHERE k = len(m))"""


def peaks(source: str, step_minutes: int, distance: int, prominence: float) -> str:
    """``found`` (port, state, datetime_ist, height_m): prominent peaks of ``source`` (port, datetime_ist, height_m)."""
    grp = "port, block_id, sg"
    same = "p.port = q.port AND p.block_id = q.block_id AND p.sg = q.sg"
    return f"""pb AS (SELECT port, datetime_ist, height_m, sum(gap) OVER (PARTITION BY port ORDER BY datetime_ist ROWS UNBOUNDED PRECEDING) AS block_id FROM
  (SELECT *, CASE WHEN date_diff('minute', lag(datetime_ist) OVER (PARTITION BY port ORDER BY datetime_ist), datetime_ist) <> {step_minutes} THEN 1 ELSE 0 END AS gap FROM {source})),
px AS MATERIALIZED (SELECT * FROM (SELECT port, block_id, sg, sg * height_m AS x, height_m AS h, datetime_ist, row_number() OVER (PARTITION BY {grp} ORDER BY datetime_ist) - 1 AS idx, count(*) OVER (PARTITION BY {grp}) AS size FROM pb, (VALUES (1), (-1)) AS s(sg)) WHERE size >= 5),
pr AS (SELECT {grp}, run, min(idx) AS i, max(idx) AS j, any_value(x) AS x FROM (SELECT *, sum(new) OVER (PARTITION BY {grp} ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM
  (SELECT *, CASE WHEN lag(x) OVER (PARTITION BY {grp} ORDER BY idx) = x THEN 0 ELSE 1 END AS new FROM px)) GROUP BY {grp}, run),
pk AS MATERIALIZED (SELECT {grp}, (i + j) // 2 AS idx, x, row_number() OVER (PARTITION BY {grp} ORDER BY x DESC, i DESC) AS rk FROM
  (SELECT *, lag(x) OVER (PARTITION BY {grp} ORDER BY run) AS p, lead(x) OVER (PARTITION BY {grp} ORDER BY run) AS f FROM pr) WHERE p < x AND f < x),
pg AS (SELECT DISTINCT {grp}, 0::BIGINT AS rk, []::BIGINT[] AS kept FROM pk UNION ALL
  SELECT q.port, q.block_id, q.sg, p.rk, CASE WHEN len(list_filter(q.kept, lambda y: abs(y - p.idx) < {distance})) > 0 THEN q.kept ELSE list_append(q.kept, p.idx) END FROM pg q JOIN pk p ON {same} AND p.rk = q.rk + 1),
pf AS (SELECT {grp}, unnest(arg_max(kept, rk)) AS idx FROM pg GROUP BY {grp}),
pe AS (SELECT p.port, p.block_id, p.sg, p.idx, q.x, q.h, q.datetime_ist,
    coalesce((SELECT max(y.idx) FROM px y WHERE y.port = p.port AND y.block_id = p.block_id AND y.sg = p.sg AND y.idx < p.idx AND y.x > q.x), -1) AS l,
    coalesce((SELECT min(y.idx) FROM px y WHERE y.port = p.port AND y.block_id = p.block_id AND y.sg = p.sg AND y.idx > p.idx AND y.x > q.x), 1000000000) AS r
  FROM pf p JOIN px q ON {same} AND p.idx = q.idx),
pm AS (SELECT p.port, p.block_id, p.sg, p.idx, any_value(p.x) AS x, any_value(p.h) AS h, any_value(p.datetime_ist) AS datetime_ist, min(q.x) FILTER (q.idx <= p.idx) AS lo, min(q.x) FILTER (q.idx >= p.idx) AS hi,
    max(q.h) FILTER (q.idx = p.idx - 1) AS hp, max(q.h) FILTER (q.idx = p.idx + 1) AS hf FROM pe p JOIN px q ON {same} AND q.idx > p.l AND q.idx < p.r GROUP BY p.port, p.block_id, p.sg, p.idx HAVING any_value(p.x) - greatest(min(q.x) FILTER (q.idx <= p.idx), min(q.x) FILTER (q.idx >= p.idx)) >= {prominence!r}),
pn AS (SELECT m.*, before.h AS bh, after.h AS ah FROM pm m JOIN px before ON before.port = m.port AND before.block_id = m.block_id AND before.sg = m.sg AND before.idx = m.idx - 1 JOIN px after ON after.port = m.port AND after.block_id = m.block_id AND after.sg = m.sg AND after.idx = m.idx + 1),
pv AS (SELECT *, (bh - 2 * h + ah) / 2 AS a, (ah - bh) / 2 AS b FROM pn),
po AS (SELECT *, CASE WHEN a = 0 THEN 0.0 ELSE greatest(-1.0, least(1.0, -b / (2 * a))) END AS o FROM pv),
found AS (SELECT port, CASE WHEN sg > 0 THEN 'High' ELSE 'Low' END AS state, datetime_ist + to_microseconds(CAST(round(o * {step_minutes * 60_000_000}) AS BIGINT)) AS datetime_ist, h + b * o + a * o * o AS height_m FROM po)"""


def matched(observed: str, predicted: str, most_micros: int | None) -> str:
    """``pairs``: greedy matches of ``observed`` and ``predicted`` (port, state, datetime_ist, height_m)."""
    limit = "" if most_micros is None else f" AND abs(date_diff('microsecond', o.datetime_ist, p.datetime_ist)) <= {most_micros}"
    return f"""mo AS (SELECT *, row_number() OVER (PARTITION BY port, state ORDER BY datetime_ist, height_m) AS k FROM {observed}),
mp AS (SELECT *, row_number() OVER (PARTITION BY port ORDER BY datetime_ist, state, height_m) - 1 AS idx FROM {predicted}),
ms AS (SELECT DISTINCT port, state, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS best FROM mo UNION ALL
  SELECT port, state, k, CASE WHEN best IS NULL THEN used ELSE list_append(used, best) END, best FROM (
    SELECT r.port, r.state, o.k, any_value(r.used) AS used, arg_min(p.idx, abs(date_diff('microsecond', o.datetime_ist, p.datetime_ist))::HUGEINT * 1000000 + p.idx) AS best
    FROM ms r JOIN mo o ON o.port = r.port AND o.state = r.state AND o.k = r.k + 1 LEFT JOIN mp p ON p.port = r.port AND p.state = r.state AND NOT list_contains(r.used, p.idx){limit} GROUP BY r.port, r.state, o.k)),
pairs AS (SELECT o.port, o.state, p.idx AS predicted_index, o.datetime_ist AS observed_datetime_ist, p.datetime_ist AS predicted_datetime_ist, date_diff('microsecond', o.datetime_ist, p.datetime_ist) / 6e7 AS time_error_minutes,
  o.height_m AS observed_height_m, p.height_m AS predicted_height_m, p.height_m - o.height_m AS height_error_m FROM ms JOIN mo o ON o.port = ms.port AND o.state = ms.state AND o.k = ms.k JOIN mp p ON p.port = ms.port AND p.idx = ms.best)"""
