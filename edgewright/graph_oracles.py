"""SQL of the queries that need more than a line: recursive searches, samplers, propagation and reports."""

from __future__ import annotations


def _hex(text: str, start: int, n: int) -> str:
    return f"('0x' || substr(md5({text}), {start}, {n}))::BIGINT"


_SOUND = "v AS (SELECT triple_id, h, r, t, CAST(length(h) AS DOUBLE) AS a, CAST(length(t) AS DOUBLE) AS b FROM triples_clean WHERE h IS NOT NULL AND r IS NOT NULL AND t IS NOT NULL)"
_MEANS = f"""{_SOUND}, i AS (SELECT 'h' AS side, h AS entity, * FROM v UNION ALL SELECT 't', t, * FROM v),
s AS (SELECT entity, sum(a) AS a, sum(b) AS b, count(*) AS n FROM i GROUP BY entity), o AS (SELECT entity, h, r, t, sum(a) AS a, sum(b) AS b, count(*) AS m FROM i GROUP BY ALL),
m AS (SELECT i.triple_id, side, i.a, i.b, s.n - m AS n, CASE WHEN s.n > m THEN (s.a - o.a) / (s.n - m) ELSE 0.0 END AS x, CASE WHEN s.n > m THEN (s.b - o.b) / (s.n - m) ELSE 0.0 END AS y
  FROM i JOIN s ON i.entity = s.entity JOIN o ON i.entity = o.entity AND i.h = o.h AND i.r = o.r AND i.t = o.t)"""


def _cos(a: str, b: str, c: str, d: str) -> str:
    size = f"(sqrt({a} * {a} + {b} * {b}) * sqrt({c} * {c} + {d} * {d}))"
    return f"round(CASE WHEN {size} > 0 THEN ({a} * {c} + {b} * {d}) / {size} ELSE 0 END, 6)::DOUBLE"


def _gap(a: str, b: str, c: str, d: str) -> str:
    return f"round(sqrt(({a} - {c}) * ({a} - {c}) + ({b} - {d}) * ({b} - {d})) / sqrt(2.0), 6)::DOUBLE"


_SAMPLED = f"""ends AS (SELECT DISTINCT entity, triple_id, h, r, t FROM (SELECT h AS entity, * FROM triples_clean UNION ALL SELECT t, * FROM triples_clean) WHERE entity IS NOT NULL),
met AS (SELECT a.triple_id, a.entity, b.triple_id AS other_id, row_number() OVER (PARTITION BY a.triple_id, a.entity ORDER BY md5('0-' || b.triple_id), b.triple_id) AS k FROM ends a JOIN ends b ON a.entity = b.entity
  AND NOT (a.h IS NOT DISTINCT FROM b.h AND a.r IS NOT DISTINCT FROM b.r AND a.t IS NOT DISTINCT FROM b.t)),
sampled AS (SELECT triple_id, entity, other_id FROM met WHERE k <= 4)"""
_TILE = f"""{_SAMPLED}, own AS (SELECT triple_id, h, t FROM triples_clean WHERE h IS NOT NULL AND t IS NOT NULL),
near AS (SELECT DISTINCT s.triple_id, s.other_id, o.h, o.t FROM sampled s JOIN own o ON s.other_id = o.triple_id WHERE s.triple_id IN (SELECT triple_id FROM own))"""

_NAMED = """walk AS (SELECT graph_id, node, node AS c FROM n UNION SELECT walk.graph_id, e.dst, walk.c FROM walk JOIN e ON walk.graph_id = e.graph_id AND walk.node = e.src),
named AS (SELECT graph_id, node, min(c) AS c FROM walk GROUP BY ALL),
main AS (SELECT named.graph_id, node FROM named JOIN (SELECT graph_id, c, row_number() OVER (PARTITION BY graph_id ORDER BY count(*) DESC, c) AS z FROM named GROUP BY graph_id, c) q ON named.graph_id = q.graph_id AND named.c = q.c WHERE z = 1)"""


def _votes(rounds: int) -> str:
    out = ["both_ways AS (SELECT graph_id, src, dst FROM e UNION SELECT graph_id, dst, src FROM e)", "l0 AS (SELECT graph_id, node, node AS community FROM n)"]
    for k in range(1, rounds + 1):
        out.append(
            f"""l{k} AS (SELECT graph_id, node, community FROM (SELECT graph_id, node, community, row_number() OVER (PARTITION BY graph_id, node ORDER BY k DESC, community) AS z
  FROM (SELECT graph_id, node, community, count(*) AS k FROM (SELECT b.graph_id, b.dst AS node, community FROM both_ways b JOIN l{k - 1} l ON b.graph_id = l.graph_id AND b.src = l.node UNION ALL SELECT * FROM l{k - 1}) GROUP BY ALL)) WHERE z = 1)"""
        )
    return ", ".join(out)


def more_sql(u: str, d: str, pred: str) -> dict[str, str]:
    """By query; ``u`` and ``d`` define e (edges) and n (nodes) of the undirected and the directed collection, ``pred`` the scores."""
    deg = "od AS (SELECT graph_id, src AS node, count(*) AS d FROM e GROUP BY ALL), id AS (SELECT graph_id, dst AS node, count(*) AS d FROM e GROUP BY ALL)"
    per_node = "SELECT n.graph_id, n.node, round(coalesce(k.x, 0), 6)::DOUBLE AS x FROM n LEFT JOIN k ON n.graph_id = k.graph_id AND n.node = k.node"
    sweep = f"""{pred}, b AS (SELECT prob AS thr, sum(y) AS p, count(*) - sum(y) AS q FROM pred GROUP BY prob),
s AS (SELECT thr, p, sum(p) OVER (ORDER BY thr DESC) AS tp, sum(q) OVER (ORDER BY thr DESC) AS fp, sum(p) OVER () AS pos FROM b),
c AS (SELECT count(*) FILTER (prob >= 0.4 AND y = 1) AS tp, count(*) FILTER (prob >= 0.4 AND y = 0) AS fp, count(*) FILTER (prob < 0.4 AND y = 0) AS tn, count(*) FILTER (prob < 0.4 AND y = 1) AS fn FROM pred),
m AS (SELECT *, tp / CAST(greatest(1, tp + fp) AS DOUBLE) AS pr, tp / CAST(greatest(1, tp + fn) AS DOUBLE) AS re, tn / CAST(greatest(1, tn + fp) AS DOUBLE) AS tnr FROM c),
r AS (SELECT y, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS r FROM pred)"""
    logs = "z AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), q AS (SELECT vec_id, label, x, ln(list_sum(list_transform(x, lambda v: exp(v)))) AS top FROM z)"
    return {
        "six_vector": f"""WITH {d}, {deg}, w AS (SELECT a.graph_id, a.src AS i, b.dst AS j, count(*) AS cn, sum(CASE WHEN od.d > 1 THEN 1 / ln(od.d) ELSE 0 END) AS aa FROM e a JOIN e b ON a.graph_id = b.graph_id AND a.dst = b.src
  JOIN od ON od.graph_id = a.graph_id AND od.node = a.dst GROUP BY ALL),
f AS (SELECT e.graph_id, src AS i, dst AS j, CAST(o.d AS DOUBLE) AS a, CAST(id.d AS DOUBLE) AS b, coalesce(w.cn, 0) AS cn, coalesce(w.aa, 0) AS aa FROM e JOIN od o ON e.graph_id = o.graph_id AND src = o.node
  JOIN id ON e.graph_id = id.graph_id AND dst = id.node LEFT JOIN w ON e.graph_id = w.graph_id AND src = w.i AND dst = w.j)
SELECT graph_id, i, j, a AS f0, b AS f1, abs(a - b) AS f2, CAST(cn AS DOUBLE) AS f3, round(cn / (a + b - cn), 6) AS f4, round(aa, 6)::DOUBLE AS f5, b AS r0, a AS r1 FROM f""",
        "cross_entropy": f"WITH {logs} SELECT round(avg(-0.95 * (x[label + 1] - top) - 0.05 * (list_sum(x) / len(x) - top)), 6) AS loss FROM q",
        "one_vs_rest": f"""WITH {logs}, k AS (SELECT unnest(range(10)) AS c), p AS (SELECT c, exp(x[c + 1] - top) AS prob, CASE WHEN label = c THEN 1 ELSE 0 END AS y FROM q, k),
r AS (SELECT c, y, rank() OVER (PARTITION BY c ORDER BY prob) + (count(*) OVER (PARTITION BY c, prob) - 1) / 2.0 AS r FROM p),
roc AS (SELECT c, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))) AS auroc FROM r GROUP BY c HAVING sum(y) > 0 AND sum(y) < count(*)),
b AS (SELECT c, prob, sum(y) AS g, count(*) AS n FROM p GROUP BY ALL),
s AS (SELECT c, g, sum(g) OVER w AS tp, sum(n) OVER w AS seen, sum(g) OVER (PARTITION BY c) AS pos FROM b WINDOW w AS (PARTITION BY c ORDER BY prob DESC)),
ap AS (SELECT c, sum(g * tp / CAST(seen AS DOUBLE)) / max(pos) AS auprc FROM s GROUP BY c)
SELECT round(avg(auroc), 6)::DOUBLE AS auroc, round(avg(auprc), 6)::DOUBLE AS auprc FROM roc JOIN ap USING (c)""",
        "binary_report": f"""WITH {sweep} SELECT tp, fp, tn, fn, round((tp + tn) / CAST(tp + fp + tn + fn AS DOUBLE), 6) AS accuracy, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / (pr + re), 6) AS f1,
round((re + tnr) / 2, 6) AS bacc, (SELECT round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 6)::DOUBLE FROM r) AS auroc,
(SELECT round(sum(p / CAST(pos AS DOUBLE) * tp / (tp + fp)), 6)::DOUBLE FROM s) AS auprc FROM m""",
        "normalised_propagate": f"WITH {u}, {deg}, k AS (SELECT e.graph_id, src AS node, sum(dst / sqrt(a.d * b.d)) AS x FROM e JOIN od a ON e.graph_id = a.graph_id AND src = a.node JOIN od b ON e.graph_id = b.graph_id AND dst = b.node GROUP BY ALL) {per_node}",
        "edge_gated_propagate": f"WITH {d}, k AS (SELECT graph_id, src AS node, sum(greatest(dst - 1, 0)) AS x FROM e GROUP BY ALL) {per_node}",
        "attention_propagate": f"WITH {d}, cells AS (SELECT graph_id, src, dst FROM e UNION SELECT graph_id, node, node FROM n) SELECT graph_id, src AS node, round(sum(exp(CAST(src - dst AS DOUBLE)) * dst) / sum(exp(CAST(src - dst AS DOUBLE))), 6) AS x FROM cells GROUP BY ALL",
        "edge_embedding": """WITH k AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), z AS (SELECT a.vec_id, a.e AS x, b.e AS y FROM k a JOIN k b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, list_concat(list_concat(x, y), list_concat(list_transform(list_zip(x, y), lambda p: abs(p[1] - p[2])), list_transform(list_zip(x, y), lambda p: p[1] * p[2]))) AS phi FROM z""",
        "modularity": f"""WITH {u}, {deg}, m AS (SELECT graph_id, count(*) FILTER (src % 3 = dst % 3) AS within, CAST(count(*) AS DOUBLE) AS m2 FROM e GROUP BY graph_id),
q AS (SELECT graph_id, node % 3 AS c, sum(d) AS d FROM od GROUP BY ALL), dd AS (SELECT graph_id, sum(d * d) AS dd FROM q GROUP BY graph_id)
SELECT m.graph_id, round(CAST((within * m2 - dd) / (m2 * m2) AS DECIMAL(30, 12)), 6)::DOUBLE AS modularity FROM m JOIN dd ON m.graph_id = dd.graph_id""",
        "context_features": f"""WITH {_MEANS} SELECT p.triple_id, {_cos('p.a', 'p.b', 'p.x', 'p.y')} AS f0, {_gap('p.a', 'p.b', 'p.x', 'p.y')} AS f1, round(ln(1.0 + p.n), 6)::DOUBLE AS f2,
{_cos('p.a', 'p.b', 'q.x', 'q.y')} AS f3, {_gap('p.a', 'p.b', 'q.x', 'q.y')} AS f4, round(ln(1.0 + q.n), 6)::DOUBLE AS f5, {_cos('p.x', 'p.y', 'q.x', 'q.y')} AS f6, {_gap('p.x', 'p.y', 'q.x', 'q.y')} AS f7
FROM m p JOIN m q ON p.triple_id = q.triple_id AND p.side = 'h' AND q.side = 't'""",
        "sampled_incident": f"WITH {_SAMPLED} SELECT triple_id, entity, other_id FROM sampled",
        "triple_tile_nodes": f"""WITH {_TILE}, x AS (SELECT triple_id, 0 AS first, 'entity' AS kind, 'entity:' || h AS name FROM own UNION ALL SELECT triple_id, 1, 'triple', 'triple:' || triple_id FROM own UNION ALL SELECT triple_id, 2, 'entity', 'entity:' || t FROM own
  UNION ALL SELECT triple_id, 3, 'triple', 'triple:' || other_id FROM near UNION ALL SELECT triple_id, 4, 'entity', 'entity:' || h FROM near UNION ALL SELECT triple_id, 4, 'entity', 'entity:' || t FROM near),
y AS (SELECT triple_id, kind, name, min(first) AS first FROM x GROUP BY ALL)
SELECT triple_id, CAST(row_number() OVER (PARTITION BY triple_id ORDER BY first, name) - 1 AS INTEGER) AS pos, kind, name FROM y""",
        "triple_tile_edges": f"""WITH {_TILE} SELECT triple_id, 'triple:' || triple_id AS src, 'entity:' || h AS dst FROM own UNION SELECT triple_id, 'triple:' || triple_id, 'entity:' || t FROM own
UNION SELECT triple_id, 'triple:' || other_id, 'entity:' || h FROM near UNION SELECT triple_id, 'triple:' || other_id, 'entity:' || t FROM near""",
        "corrupted_triples": f"""WITH {_SOUND}, f AS (SELECT x AS entity, row_number() OVER (ORDER BY min(m)) - 1 AS code FROM (SELECT h AS x, triple_id * 2 AS m FROM v UNION ALL SELECT t, triple_id * 2 + 1 FROM v) GROUP BY x),
g AS (SELECT triple_id, h, r, t, draw, {_hex("'0-' || triple_id || '-' || draw", 1, 12)} % (SELECT count(*) FROM f) AS code, {_hex("'0-' || triple_id || '-' || draw", 13, 1)} % 2 = 0 AS head FROM v, (SELECT unnest(range(1, 31)) AS draw)),
c AS (SELECT triple_id, draw, CASE WHEN head THEN entity ELSE h END AS h, r, CASE WHEN head THEN t ELSE entity END AS t FROM g JOIN f USING (code)),
k AS (SELECT *, row_number() OVER (PARTITION BY triple_id ORDER BY draw) AS k FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.h = c.h AND v.r = c.r AND v.t = c.t))
SELECT triple_id, CAST(k AS INTEGER) AS draw, h, r, t FROM k WHERE k = 1""",
        "negative_pairs": f"""WITH {u}, k AS (SELECT graph_id, node, row_number() OVER (PARTITION BY graph_id ORDER BY node) - 1 AS k, count(*) OVER (PARTITION BY graph_id) AS m FROM n),
draws AS (SELECT DISTINCT e.graph_id, e.src AS i, j.node AS j FROM e JOIN (SELECT DISTINCT graph_id, m FROM k) q ON e.graph_id = q.graph_id, (SELECT unnest([1, 2, 3]) AS d), k j
  WHERE j.graph_id = e.graph_id AND j.k = {_hex("'0-' || e.graph_id || '-' || e.src || '-' || e.dst || '-' || d", 1, 12)} % q.m AND j.node <> e.src),
f AS (SELECT *, row_number() OVER (PARTITION BY graph_id ORDER BY md5('0-' || i || '-' || j), i, j) AS z FROM draws WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.graph_id = draws.graph_id AND e.src = draws.i AND e.dst = draws.j))
SELECT f.graph_id, i, j FROM f JOIN (SELECT graph_id, count(*) AS m FROM e GROUP BY graph_id) c ON f.graph_id = c.graph_id WHERE z <= m""",
        "bfs_tree": f"""WITH RECURSIVE {u}, {_NAMED}, r AS (SELECT graph_id, min(node) AS node, 0 AS depth, [min(node)] AS path FROM main GROUP BY graph_id),
far AS (SELECT graph_id, node, 0 AS depth FROM r UNION SELECT far.graph_id, e.dst, depth + 1 FROM far JOIN e ON far.graph_id = e.graph_id AND far.node = e.src WHERE depth < 64),
level AS (SELECT graph_id, node, min(depth) AS depth FROM far GROUP BY ALL),
best AS (SELECT graph_id, node, depth, path FROM r UNION ALL SELECT b.graph_id, e.dst, b.depth + 1, min(list_append(b.path, e.dst)) FROM best b JOIN e ON b.graph_id = e.graph_id AND b.node = e.src
  JOIN level l ON l.graph_id = e.graph_id AND l.node = e.dst AND l.depth = b.depth + 1 GROUP BY b.graph_id, e.dst, b.depth)
SELECT graph_id, node, CASE WHEN depth > 0 THEN path[-2] END AS parent, depth FROM best""",
        "bounded_neighbourhood": f"""WITH RECURSIVE {u}, r AS (SELECT graph_id, 0 AS hop, [min(node)] AS held, [min(node)] AS front FROM n GROUP BY graph_id
  UNION ALL SELECT graph_id, hop + 1, list_concat(held, fresh), fresh FROM (SELECT graph_id, hop, held, (list_sort(list_distinct(list_filter(ahead, lambda x: NOT list_contains(held, x)))))[1:8 - len(held)] AS fresh
    FROM (SELECT f.graph_id, hop, held, list(e.dst) AS ahead FROM (SELECT graph_id, hop, held, unnest(front) AS x FROM r) f JOIN e ON f.graph_id = e.graph_id AND f.x = e.src GROUP BY f.graph_id, hop, held)) WHERE len(fresh) > 0)
SELECT graph_id, (first_value(front) OVER (PARTITION BY graph_id ORDER BY hop))[1] AS seed, unnest(front) AS node, hop FROM r""",
        "feedback_edges": f"""WITH RECURSIVE {u}, o AS (SELECT graph_id, src, dst, row_number() OVER (PARTITION BY graph_id ORDER BY src, dst) AS k FROM e WHERE src < dst),
s AS (SELECT graph_id, src AS a, dst AS b, k FROM o UNION ALL SELECT graph_id, dst, src, k FROM o),
reach AS (SELECT graph_id, k, src AS x FROM o UNION SELECT reach.graph_id, reach.k, s.b FROM reach JOIN s ON reach.graph_id = s.graph_id AND reach.x = s.a AND s.k < reach.k)
SELECT o.graph_id, src, dst FROM o JOIN reach ON o.graph_id = reach.graph_id AND o.k = reach.k AND reach.x = o.dst""",
        "communities": f"WITH {u}, {_votes(5)} SELECT graph_id, node, community FROM l5",
        "stitched": f"""WITH RECURSIVE {u}, {_NAMED}, body AS (SELECT graph_id, node, row_number() OVER (PARTITION BY graph_id ORDER BY md5('0-' || graph_id || '-' || node), node) - 1 AS k, count(*) OVER (PARTITION BY graph_id) AS m FROM main),
isle AS (SELECT graph_id, node, count(*) OVER (PARTITION BY graph_id, c) AS s, row_number() OVER (PARTITION BY graph_id, c ORDER BY md5('0-' || graph_id || '-' || node), node) AS r FROM named
  WHERE NOT EXISTS (SELECT 1 FROM main WHERE main.graph_id = named.graph_id AND main.node = named.node)),
b AS (SELECT i.graph_id, i.node AS src, body.node AS dst FROM isle i JOIN (SELECT DISTINCT graph_id, m FROM body) z ON i.graph_id = z.graph_id
  JOIN body ON body.graph_id = i.graph_id AND body.k = {_hex("'0-' || i.graph_id || '-' || i.node || '-to'", 1, 12)} % z.m WHERE r <= greatest(1, least(3, s // 5 + 1)))
SELECT graph_id, src, dst FROM e UNION SELECT graph_id, src, dst FROM b UNION SELECT graph_id, dst, src FROM b""",
    }


def hub_sql(table: str) -> dict[str, str]:
    """Structure of one whole graph given as an edge list ``table`` (u, v)."""
    e = f"k AS (SELECT u, v FROM {table} WHERE u <> v), e AS (SELECT u AS src, v AS dst FROM k UNION SELECT v, u FROM k), od AS (SELECT src AS node, count(*) AS d FROM e GROUP BY src)"
    w = "w AS (SELECT e.src AS i, e.dst AS j, count(b.dst) AS cn, coalesce(sum(CASE WHEN od.d > 1 THEN 1 / ln(od.d) END), 0) AS aa FROM e LEFT JOIN (e a JOIN e b ON a.dst = b.src JOIN od ON od.node = a.dst) ON a.src = e.src AND b.dst = e.dst WHERE e.src < e.dst GROUP BY e.src, e.dst)"
    flood = ["f0 AS (SELECT node, node AS c FROM od)"]
    for k in range(1, 13):
        flood.append(f"f{k} AS (SELECT node, min(c) AS c FROM (SELECT e.dst AS node, c FROM e JOIN f{k - 1} f ON e.src = f.node UNION ALL SELECT * FROM f{k - 1}) GROUP BY node)")
    return {
        "triangles": f"WITH {e} SELECT a.src AS node, CAST(count(*) // 2 AS BIGINT) AS triangles FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src AND c.dst = a.src GROUP BY a.src",
        "edge_overlaps": f"WITH {e}, {w} SELECT i, j, cn, round(cn / CAST(a.d + b.d - cn AS DOUBLE), 6) AS jaccard, round(aa, 6)::DOUBLE AS adamic_adar FROM w JOIN od a ON i = a.node JOIN od b ON j = b.node",
        "components": f"WITH {e}, {', '.join(flood)} SELECT node, c AS component FROM f12",
        "twohop": f"WITH {e}, r AS (SELECT DISTINCT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src WHERE a.src <> b.dst) SELECT src AS node, count(*) AS twohop FROM r WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = r.src AND e.dst = r.dst) GROUP BY src",
        "common_neighbours": f"WITH {e} SELECT a.src AS i, b.dst AS j, count(*) AS cn FROM e a JOIN e b ON a.dst = b.src GROUP BY ALL",
    }
