"""The queries in DuckDB's SQL, where SQL can express them."""

from __future__ import annotations

from .queries import BIN, LIMIT, NARROW

_STREAM = """WITH RECURSIVE o AS (
  SELECT o_orderkey AS tx_id, o_orderkey // 50 AS block_id, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
         lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p0 FROM orders),
ins AS (
  SELECT o.tx_id AS seq, o.tx_id, 0 AS pos, o.p0 AS prev_tx_id, p.cents AS amount FROM o JOIN o p ON p.tx_id = o.p0
  UNION ALL
  SELECT o.tx_id, o.tx_id, 1, p.tx_id, p.cents FROM o JOIN o p ON p.tx_id = o.tx_id - 7 WHERE o.tx_id % 5 = 0 AND o.p0 IS NOT NULL),
recs AS (
  SELECT tx_id AS seq, block_id, tx_id, coalesce(n, 0) + CASE WHEN tx_id % 3 = 0 THEN 1 ELSE 0 END AS outputs
  FROM o LEFT JOIN (SELECT prev_tx_id AS tx_id, count(*) AS n FROM ins GROUP BY 1) USING (tx_id))"""

_BROKEN = (
    _STREAM
    + """,
brecs AS (SELECT seq, block_id, CASE WHEN tx_id % 11 = 3 THEN greatest(tx_id - 5, 0) ELSE tx_id END AS tx_id, greatest(outputs - CASE WHEN seq % 13 = 0 THEN 1 ELSE 0 END, 0) AS outputs FROM recs),
bins AS (SELECT seq, CASE WHEN tx_id % 11 = 3 THEN greatest(tx_id - 5, 0) ELSE tx_id END AS tx_id, pos, CASE WHEN seq % 17 = 0 THEN prev_tx_id + 100000000 ELSE prev_tx_id END AS prev_tx_id, CASE WHEN amount % 7 = 0 THEN 0 ELSE amount END AS amount FROM ins),
vers AS (SELECT tx_id, seq AS version_seq, lead(seq) OVER (PARTITION BY tx_id ORDER BY seq) AS until_seq, outputs FROM brecs WHERE outputs > 0),
held AS (SELECT i.*, (SELECT max(v.version_seq) FROM vers v WHERE v.tx_id = i.prev_tx_id AND v.version_seq < i.seq) AS version_seq FROM bins i),
ranked AS (SELECT h.*, v.outputs, row_number() OVER (PARTITION BY h.version_seq ORDER BY h.seq, h.pos DESC) AS k FROM held h LEFT JOIN vers v USING (version_seq)),
left_ AS (SELECT v.tx_id, v.version_seq, v.outputs, coalesce(n, 0) AS spent, v.outputs - coalesce(n, 0) AS unspent, v.until_seq IS NULL AND coalesce(n, 0) < v.outputs AS live
  FROM vers v LEFT JOIN (SELECT version_seq, count(*) AS n FROM ranked WHERE k <= outputs AND version_seq IS NOT NULL GROUP BY 1) USING (version_seq))"""
)

_COLORS = (
    _STREAM
    + """,
color(tx_id, block) AS (SELECT tx_id, block_id FROM o WHERE p0 IS NULL UNION SELECT e.tx_id, c.block FROM color c JOIN ins e ON e.prev_tx_id = c.tx_id)"""
)
_WEIGHTS = (
    _STREAM
    + """,
shared AS (SELECT tx_id, prev_tx_id, CASE WHEN sum(amount) OVER (PARTITION BY tx_id) > 0 THEN amount / sum(CAST(amount AS DOUBLE)) OVER (PARTITION BY tx_id) ELSE 1.0 / count(*) OVER (PARTITION BY tx_id) END AS share FROM ins),
walk(tx_id, block, w) AS (SELECT tx_id, block_id, CAST(1.0 AS DOUBLE) FROM o WHERE p0 IS NULL UNION ALL SELECT e.tx_id, c.block, c.w * e.share FROM walk c JOIN shared e ON e.prev_tx_id = c.tx_id),
weights AS (SELECT tx_id, block, sum(w) AS w, count(*) AS paths FROM walk GROUP BY 1, 2)"""
)
_SIX = "printf('%d.%06d', CAST(round({0} * 1000000) AS BIGINT) // 1000000, CAST(round({0} * 1000000) AS BIGINT) % 1000000)"
_PIXELS = (
    _COLORS
    + f""",
pixels AS (SELECT DISTINCT tx_id // {BIN} AS "row", block FROM color),
size AS (SELECT max(block_id) + 1 AS width, (count(*) + {BIN - 1}) // {BIN} AS rows FROM recs),
runs AS (SELECT "row", min(block) AS start, count(*) AS length FROM (SELECT "row", block, block - row_number() OVER (PARTITION BY "row" ORDER BY block) AS island FROM pixels) GROUP BY "row", island)"""
)
_GRAPH = (
    _STREAM
    + """,
arcs AS (SELECT DISTINCT prev_tx_id AS src, tx_id AS dst FROM ins UNION SELECT o_orderkey, o_orderkey - 3 FROM orders WHERE o_orderkey % 97 = 0 AND o_orderkey >= 3)"""
)
_ROOTS = (
    _GRAPH
    + """,
reach(u, w) AS (SELECT o_orderkey, o_orderkey FROM orders UNION SELECT r.u, a.dst FROM reach r JOIN arcs a ON a.src = r.w),
roots AS (SELECT w AS node, min(u) AS root FROM reach GROUP BY w)"""
)
_KEYS = """WITH k AS (SELECT o_orderkey AS k FROM orders),
wa AS (SELECT k, unnest([k % 3, 3 + k % 5]) AS block, unnest([0.25::DOUBLE, 0.75::DOUBLE]) AS w FROM k),
wb AS (SELECT k, unnest([k % 2, 2 + k % 7]) AS block, unnest([0.5::DOUBLE, 0.5::DOUBLE]) AS w FROM k),
p AS (SELECT k, unnest([10 + k % 4, k % 9]) AS e, unnest([k % 6, k % 10]) AS c FROM k),
q AS (SELECT k, unnest([10 + k % 3, k % 8]) AS e, unnest([k % 7, k % 5]) AS c FROM k)"""


def _poly(f: str) -> str:
    return f"{_KEYS} SELECT k AS o_orderkey, string_agg(e || ':' || c, ' ' ORDER BY e DESC) AS terms FROM (SELECT coalesce(p.k, q.k) AS k, coalesce(p.e, q.e) AS e, CASE WHEN p.c IS NULL THEN q.c WHEN q.c IS NULL THEN p.c ELSE {f} END AS c FROM p FULL JOIN q ON p.k = q.k AND p.e = q.e) GROUP BY k"


# A level's walk order is that of the nodes' paths from the root; a node's parent ends the least path that reaches it.
_PATHS = (
    f"{_ROOTS}, walk(node, root, depth) AS (SELECT node, root, 0 FROM roots WHERE node = root UNION SELECT r.node, r.root, w.depth + 1 FROM walk w JOIN arcs a ON a.src = w.node JOIN roots r ON r.node = a.dst AND r.root = w.root WHERE w.depth < 200), "
    "depths AS (SELECT node, root, min(depth) AS depth FROM walk GROUP BY node, root), "
    "paths(node, root, depth, path) AS (SELECT node, root, depth, [node] FROM depths WHERE depth = 0 "
    "UNION ALL SELECT d.node, d.root, d.depth, min(list_append(p.path, d.node)) FROM paths p JOIN arcs a ON a.src = p.node JOIN depths d ON d.node = a.dst AND d.root = p.root AND d.depth = p.depth + 1 GROUP BY d.node, d.root, d.depth)"
)

ORACLES: dict[str, str] = {
    "scan_records": f"{_STREAM} SELECT seq, block_id, tx_id, outputs, coalesce(n, 0) AS n_inputs, coalesce(paid, 0)::BIGINT AS paid FROM recs LEFT JOIN (SELECT tx_id, count(*) AS n, sum(amount) AS paid FROM ins GROUP BY 1) USING (tx_id)",
    "scan_prune": f"{_STREAM} SELECT seq, block_id, tx_id FROM recs",
    "scan_validate": "SELECT o_orderkey AS seq, CASE o_orderkey % 40 WHEN 1 THEN 'expected an integer' WHEN 2 THEN 'negative integer' WHEN 3 THEN 'record header has 2 fields' WHEN 4 THEN 'malformed record' ELSE 'does not fit in a usize' END AS reason FROM orders WHERE o_orderkey % 40 BETWEEN 1 AND 5",
    "graph_arcs": f"{_GRAPH} SELECT src, dst FROM arcs",
    "graph_successors": f"{_GRAPH} SELECT src, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS successors FROM arcs GROUP BY src",
    "coinbase_colors": f"{_STREAM} SELECT tx_id, block_id AS block FROM o WHERE p0 IS NULL",
    "versions": f"{_BROKEN} SELECT tx_id, version_seq, until_seq, outputs FROM vers",
    "spend_edges": f"{_STREAM} SELECT seq, pos, prev_tx_id AS version_seq, amount FROM ins",
    "asof_versions": f"{_BROKEN} SELECT seq, pos, prev_tx_id, version_seq FROM held",
    "utxo_spend_rank": f"{_BROKEN} SELECT seq, pos, version_seq, outputs, k AS spend_rank FROM ranked WHERE version_seq IS NOT NULL",
    "utxo_remaining": f"{_BROKEN} SELECT tx_id, version_seq, outputs, spent, unspent, live FROM left_",
    "utxo_live": f"{_BROKEN} SELECT tx_id, version_seq, outputs, spent, unspent FROM left_ WHERE live",
    "unknown_spends": f"{_BROKEN} SELECT seq, pos, tx_id, prev_tx_id FROM ranked WHERE version_seq IS NULL OR k > outputs",
    "first_unknown_spend": f"{_BROKEN} SELECT seq, pos, tx_id, prev_tx_id, 'transaction ' || tx_id || ' spends unknown transaction ' || prev_tx_id AS message FROM ranked WHERE version_seq IS NULL OR k > outputs ORDER BY seq, pos DESC LIMIT 1",
    "input_share": f"{_BROKEN} SELECT seq, pos, CAST(round(1e6 * CASE WHEN sum(amount) OVER (PARTITION BY seq) > 0 THEN amount / sum(CAST(amount AS DOUBLE)) OVER (PARTITION BY seq) ELSE 1.0 / count(*) OVER (PARTITION BY seq) END) AS BIGINT) AS share FROM bins",
    "color_closure": f"{_COLORS} SELECT tx_id, block FROM color",
    "color_weighted": f"{_WEIGHTS} SELECT tx_id, block, CAST(round(w * 1000000) AS BIGINT) AS millionths FROM weights",
    "path_counts": f"{_WEIGHTS} SELECT tx_id, block, paths FROM weights",
    "weight_drift": f"{_WEIGHTS} SELECT max(abs(s - 1)) < 1e-12 AS sums_to_one FROM (SELECT sum(w) AS s FROM weights GROUP BY tx_id)",
    "color_terms_desc": f"{_COLORS} SELECT tx_id AS seq, string_agg(CAST(block AS VARCHAR), ' ' ORDER BY block DESC) AS terms FROM color GROUP BY tx_id",
    "text_lines": f"{_COLORS} SELECT tx_id AS seq, string_agg('(' || block || ' . 1) ', '' ORDER BY block DESC) AS line FROM color GROUP BY tx_id",
    "weighted_text": f"{_WEIGHTS} SELECT tx_id AS seq, string_agg('(' || block || ' . ' || {_SIX.format('w')} || ') ', '' ORDER BY block DESC) AS line FROM weights GROUP BY tx_id",
    "record_limit": f"{_STREAM} SELECT seq, tx_id, block_id FROM recs WHERE seq < {LIMIT}",
    "survey": f"{_STREAM} SELECT coalesce(max(block_id) + 1, 0) AS blocks, count(*) AS records FROM recs",
    "escaped_block": f"{_COLORS} SELECT tx_id AS seq, max(block) AS block, 'block ' || max(block) || ' has no column in a {NARROW}-column picture; rerun with --blocks ' || (max(block) + 1) || ' or more' AS message FROM color WHERE block >= {NARROW} GROUP BY tx_id ORDER BY tx_id LIMIT 1",
    "stats_progress": f"{_COLORS}, sizes AS (SELECT tx_id, count(*) AS size FROM color GROUP BY 1), used AS (SELECT prev_tx_id AS tx_id, seq AS place, row_number() OVER (PARTITION BY prev_tx_id ORDER BY seq, pos DESC) AS k FROM ins), "
    "events AS (SELECT r.seq AS place, 1 AS n, s.size AS d FROM recs r JOIN sizes s USING (tx_id) WHERE r.outputs > 0 UNION ALL SELECT u.place, -1, -s.size FROM used u JOIN recs r USING (tx_id) JOIN sizes s USING (tx_id) WHERE u.k = r.outputs), "
    "sums AS (SELECT place, sum(n) AS n, sum(d) AS d FROM events GROUP BY 1), so_far AS (SELECT place, sum(n) OVER (ORDER BY place) AS txs, sum(d) OVER (ORDER BY place) AS live FROM sums), "
    f"marks AS (SELECT unnest(range({LIMIT}, (SELECT count(*) FROM recs) + 1, {LIMIT})) AS records) "
    "SELECT m.records, arg_max(txs, place)::BIGINT AS live_txs, arg_max(live, place)::BIGINT AS set_elements, max(live)::BIGINT AS peak_elements FROM marks m JOIN so_far u ON u.place < m.records GROUP BY 1",
    "stats_live": f"{_COLORS}, used AS (SELECT prev_tx_id AS tx_id, count(*) AS n FROM ins GROUP BY 1), held AS (SELECT tx_id FROM recs LEFT JOIN used USING (tx_id) WHERE outputs > coalesce(n, 0)), sizes AS (SELECT tx_id, count(*) AS size FROM color GROUP BY 1) SELECT count(*) AS live_txs, sum(size)::BIGINT AS set_elements, (1 + sum(size + 1))::BIGINT AS ring_nodes FROM held JOIN sizes USING (tx_id)",
    "bin_rows": f'{_PIXELS} SELECT "row", block FROM pixels',
    "row_runs": f'{_PIXELS} SELECT "row", start, length FROM runs',
    "pbm_rows": f"""{_PIXELS}, bits AS (SELECT "row", block // 8 AS byte, bit_or(CAST(128 >> CAST(block % 8 AS INT) AS INT)) AS bits FROM pixels GROUP BY 1, 2),
cells AS (SELECT r AS "row", b AS byte FROM (SELECT unnest(range(rows)) AS r FROM size), (SELECT unnest(range((width + 7) // 8)) AS b FROM size))
SELECT c."row", string_agg(printf('%02x', coalesce(bits, 0)), '' ORDER BY c.byte) AS bytes FROM cells c LEFT JOIN bits USING ("row", byte) GROUP BY 1""",
    "svg_strokes": f"""{_PIXELS}, pens AS (SELECT "row", start, length, lag(start + length) OVER w AS x, lag("row") OVER w AS y FROM runs WINDOW w AS (ORDER BY "row", start))
SELECT "row", start, CASE WHEN x IS NULL THEN 'M' || start || ' ' || "row" ELSE 'm' || (start - x) || ' ' || ("row" - y) END || 'h' || length AS stroke FROM pens""",
    "svg_header": f"""{_STREAM}, size AS (SELECT max(block_id) + 1 AS w, (count(*) + {BIN - 1}) // {BIN} AS h FROM recs)
SELECT '<svg xmlns="http://www.w3.org/2000/svg" width="' || w || '" height="' || h || '" viewBox="0 0 ' || w || ' ' || h || '" shape-rendering="crispEdges"' || repeat(' ', 2 * (20 - length(CAST(h AS VARCHAR)))::INT) || '><rect width="100%" height="100%" fill="#fff"/><path fill="none" stroke="#000" stroke-width="1" transform="translate(0,.5)" d="' AS header FROM size""",
    "picture_stats": f"{_PIXELS} SELECT any_value(width) AS columns, any_value(rows) AS rows, count(*) AS runs, count(*) // any_value(rows) AS runs_a_row, (any_value(width) + 7) // 8 AS pbm_row_bytes, 7 * (count(*) // any_value(rows)) AS svg_row_bytes FROM runs, size",
    "color_union": "SELECT o_orderkey, array_to_string(list_sort(list_distinct([o_orderkey % 7, o_orderkey % 11, o_orderkey % 13, o_orderkey % 5, o_orderkey % 17])), ' ') AS blocks FROM orders",
    "color_combine": f"{_KEYS} SELECT k AS o_orderkey, string_agg(block || ':' || {_SIX.format('w')}, ' ' ORDER BY block DESC) AS terms FROM (SELECT k, block, sum(w) AS w FROM (SELECT k, block, w * 0.4::DOUBLE AS w FROM wa UNION ALL SELECT k, block, w * 0.6::DOUBLE FROM wb) GROUP BY k, block) GROUP BY k",
    "color_scale": f"{_KEYS} SELECT k AS o_orderkey, string_agg(block || ':' || {_SIX.format('(w * 0.125)')}, ' ' ORDER BY block DESC) AS terms FROM wa GROUP BY k",
    "poly_op": _poly("greatest(p.c, q.c)"),
    "poly_add": _poly("p.c + q.c"),
    "poly_ior": _poly("p.c | q.c"),
    "rate_format": "SELECT o_orderkey, CASE WHEN s <= 0 THEN '-- rec/s' WHEN n / s >= 1e6 THEN printf('%.1fM rec/s', n / s / 1e6) WHEN n / s >= 1e3 THEN printf('%.0fk rec/s', n / s / 1e3) ELSE printf('%.0f rec/s', n / s) END AS rate FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey AS DOUBLE) AS n, (o_orderkey % 8) / 4.0::DOUBLE AS s FROM orders)",
    "human_size": "SELECT o_orderkey, CASE WHEN b < 1e3 THEN CAST(b AS BIGINT) || ' B' WHEN b < 1e6 THEN printf('%.1f kB', b / 1e3) WHEN b < 1e9 THEN printf('%.1f MB', b / 1e6) WHEN b < 1e12 THEN printf('%.1f GB', b / 1e9) ELSE printf('%.1f TB', b / 1e12) END AS size FROM (SELECT o_orderkey, CAST(o_orderkey * o_orderkey * CASE o_orderkey % 3 WHEN 0 THEN 50 WHEN 1 THEN 1 ELSE 100000 END AS DOUBLE) AS b FROM orders)",
    "forest_roots": f"{_ROOTS} SELECT node, root FROM roots",
    "forest_depth": f"{_ROOTS}, walk(node, root, depth) AS (SELECT node, root, 0 FROM roots WHERE node = root UNION SELECT r.node, r.root, w.depth + 1 FROM walk w JOIN arcs a ON a.src = w.node JOIN roots r ON r.node = a.dst AND r.root = w.root WHERE w.depth < 200) SELECT node, root, min(depth) AS depth FROM walk GROUP BY node, root",
    "forest_parents": f"{_PATHS} SELECT node, root, CASE WHEN depth > 0 THEN path[depth] END AS parent, row_number() OVER (PARTITION BY root ORDER BY depth, path) AS rank FROM paths",
    "forest_leaves": f"{_PATHS} SELECT node FROM paths p WHERE node NOT IN (SELECT path[depth] FROM paths WHERE depth > 0)",
    "forest_summary": f"{_ROOTS}, facts AS (SELECT count(*) AS nodes, count(*) FILTER (WHERE node = root) AS roots, (SELECT count(*) FROM arcs) AS arcs FROM roots) SELECT nodes, roots, roots > 1 AS synthetic_root, arcs - (nodes - roots) AS dropped_arcs, nodes || ' nodes, ' || roots || ' root(s)' || CASE WHEN roots > 1 THEN ', one added root standing for no node' ELSE '' END || CASE WHEN arcs - (nodes - roots) > 0 THEN chr(10) || (arcs - (nodes - roots)) || ' arc(s) not drawn: they would have given a node a second parent' ELSE '' END AS text FROM facts",
}
