"""SQL for quality islands: the scan rule as list expressions, stepped along each read by a recursive query."""

from __future__ import annotations


def _scan(left: str, rise: bool, threshold: int, window: int) -> str:
    """The last position outside the region looked for, or -2 - position if there is none, from the columns q and tot (sums before each place)."""
    kind = "true" if rise else "false"
    high = lambda at: f"((tot[{at} + w + 1] - tot[{at} + 1]) >= {threshold} * w)"
    back = f"list_min(list_filter(range(1, w + 1), lambda b: l < b OR {high('l - b')} <> {kind}))"
    start = f"coalesce(list_min(list_filter(range(l, len(q) - w + 1), lambda s: {high('s')} = {kind})), len(q) - w)"
    edge = f"CASE WHEN {high('l')} = {kind} THEN {{'e': coalesce(l + w - {back}, l - 1), 'r': true}} ELSE list_transform([{start}], lambda s: {{'e': s + w - 1, 'r': {high('s')} = {kind}}})[1] END"
    found = f"greatest(l - 1, coalesce(list_max(list_filter(range(0, x.e + 1), lambda i: (q[i + 1] >= {threshold}) <> {kind})), -1))"
    inner = f"list_transform([{edge}], lambda x: CASE WHEN x.r THEN {found} ELSE -2 - {found} END)[1]"
    return f"list_transform([CAST({left} AS BIGINT)], lambda l: list_transform([least(len(q) - l, {window})], lambda w: {inner})[1])[1]"


def islands(source: str, name: str = "islands", threshold: int = 8, window: int = 4) -> str:
    """CTEs that end in `name` (doc_id, lower, upper, weight), from `source` (doc_id, q)."""
    return f"""{name}_walk(doc_id, q, tot, place, lower, upper) AS (
  SELECT doc_id, q, list_transform(range(0, len(q) + 1), lambda i: coalesce(list_sum(list_slice(q, 1, i)), 0)), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM {source}
  UNION ALL
  SELECT doc_id, q, tot, CASE WHEN outside < -1 THEN len(q) ELSE beyond + 1 END,
    CASE WHEN outside >= -1 AND beyond - outside >= {window} THEN outside + 1 END, CASE WHEN outside >= -1 AND beyond - outside >= {window} THEN beyond + 1 END
  FROM (SELECT *, CASE WHEN fall >= -1 THEN fall ELSE -2 - fall END AS beyond FROM (
    SELECT *, {_scan("greatest(outside, -1) + 1", False, threshold, window)} AS fall FROM (
      SELECT *, {_scan("place", True, threshold, window)} AS outside FROM {name}_walk WHERE place < len(q))))),
{name}_met AS (SELECT *, CASE WHEN lag(upper) OVER (PARTITION BY doc_id ORDER BY lower) = lower THEN 0 ELSE 1 END AS fresh FROM {name}_walk WHERE lower IS NOT NULL),
{name}_run AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY lower) AS run FROM {name}_met),
{name} AS (SELECT doc_id, CAST(min(lower) AS INTEGER) AS lower, CAST(max(upper) AS INTEGER) AS upper, any_value(tot[upper_end + 1] - tot[lower_end + 1]) AS weight FROM (
  SELECT *, max(upper) OVER (PARTITION BY doc_id, run) AS upper_end, min(lower) OVER (PARTITION BY doc_id, run) AS lower_end FROM {name}_run) GROUP BY doc_id, run),
{name}_best AS (SELECT doc_id, lower, upper FROM {name} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, lower) = 1)"""
