"""DuckDB SQL with the rows of the catalogue's queries."""

from __future__ import annotations

from .functions.scalars import DEFAULT_SEED, MODULUS
from .schemas import CODES

EDGES = """e AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey),
v AS (SELECT src AS id FROM e UNION SELECT dst FROM e)"""

TRADE = """base AS (SELECT l_suppkey * 2 AS src, o_custkey * 2 + 1 AS dst, CAST(substring(p_brand, 7) AS BIGINT) AS topic, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE) AS amount
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3),
t AS (SELECT src, dst, 'SALE' AS type, 'CUSTOMER' AS dst_type, amount, topic FROM base UNION ALL SELECT dst, src, 'PURCHASE', 'SUPPLIER', amount, topic FROM base),
tv AS (SELECT s_suppkey * 2 AS id, 'SUPPLIER' AS type FROM supplier UNION ALL SELECT c_custkey * 2 + 1, 'CUSTOMER' FROM customer)"""

#: per vertex sums and weighted edges; MONEY sums are exact.
INFLUENCE = f"""{TRADE},
sums AS (SELECT src AS id, CAST(sum(CASE WHEN type = 'SALE' THEN CAST(amount AS DECIMAL(18, 4)) ELSE 0 END) AS DOUBLE) AS sold, CAST(sum(CASE WHEN type = 'PURCHASE' THEN CAST(amount AS DECIMAL(18, 4)) ELSE 0 END) AS DOUBLE) AS bought FROM t GROUP BY 1),
tr AS (SELECT tv.id, coalesce(sold, 0.0) AS sold, coalesce(bought, 0.0) AS bought FROM tv LEFT JOIN sums USING (id)),
w AS (SELECT t.src, t.dst, t.type, t.topic, t.amount, coalesce(t.amount / tr.sold, 0.0) AS weight FROM t LEFT JOIN tr ON tr.sold > 0 AND tr.id = CASE WHEN t.type = 'SALE' THEN t.src ELSE t.dst END)"""


def coin(s: str, a: str, b: str, seed: int = DEFAULT_SEED) -> str:
    return f"((((({s}) * 69621 + ({a}) * 48271) % {MODULUS}) * 40692 + ({b}) * 16807 + {seed}) % {MODULUS}) * 48271 % {MODULUS}"


SPACES = "CASE {} WHEN 'PERSON' THEN 0 WHEN 'FORUM' THEN 1 WHEN 'FORUMEVENT' THEN 2 WHEN 'PUBLICATION' THEN 3 ELSE 4 END"

#: the typed graph of the records: the same edges, straight from the tables.
RECORDS = """r AS (
  SELECT o_custkey AS src, o_orderkey AS dst, 'AUTHOR' AS type, 'PERSON' AS src_type, 'FORUMEVENT' AS dst_type FROM orders
  UNION ALL SELECT l_suppkey, l_orderkey, 'INCLUDES', 'FORUM', 'FORUMEVENT' FROM lineitem
  UNION ALL SELECT s_suppkey, s_nationkey, 'HASTOPIC', 'FORUM', 'TOPIC' FROM supplier
  UNION ALL SELECT p_partkey, p_partkey % 25, 'HASORG', 'PUBLICATION', 'TOPIC' FROM part
  UNION ALL SELECT c_custkey, c_custkey + 1, 'SALE', 'PERSON', 'PERSON' FROM customer),
both_ AS (SELECT * FROM r UNION ALL SELECT dst, src, CASE type WHEN 'AUTHOR' THEN 'WRITTENBY' WHEN 'INCLUDES' THEN 'INCLUDEDIN' WHEN 'HASTOPIC' THEN 'TOPICIN' WHEN 'HASORG' THEN 'ORG_IN' ELSE 'PURCHASE' END, dst_type, src_type FROM r)"""

CATALOGUE = f"""{RECORDS},
cv AS (SELECT c_custkey * 8 AS id, 'PERSON' AS type FROM customer UNION ALL SELECT s_suppkey * 8 + 1, 'FORUM' FROM supplier UNION ALL SELECT o_orderkey * 8 + 2, 'FORUMEVENT' FROM orders
  UNION ALL SELECT p_partkey * 8 + 3, 'PUBLICATION' FROM part UNION ALL SELECT CAST(n_nationkey AS BIGINT) * 8 + 4, 'TOPIC' FROM nation),
ce0 AS (SELECT CAST(src AS BIGINT) * 8 + {SPACES.format("src_type")} AS src, CAST(dst AS BIGINT) * 8 + {SPACES.format("dst_type")} AS dst, type FROM both_),
ce AS (SELECT * FROM ce0 WHERE src IN (SELECT id FROM cv) AND dst IN (SELECT id FROM cv))"""

KNOWLEDGE = """k AS (SELECT vec_id AS id, embedding AS f, label FROM embeddings),
ke AS (SELECT id AS src, (id * 7 + j * 13) % (SELECT max(vec_id) + 1 FROM embeddings) AS dst, [207, 3, 40][j % 3 + 1] AS type, id % 2 = 1 AS mirror FROM k, range(1, 6) x(j))"""


def _score(head: str, relation: str, tail: str) -> str:
    return f"round(1.0 - list_sum(list_transform(range(1, 65), lambda i: abs(CAST({head}[i] AS DOUBLE) + CAST({relation}[i] AS DOUBLE) - CAST({tail}[i] AS DOUBLE)))), 6)"


BFS = f"""WITH RECURSIVE {EDGES},
b AS (SELECT s AS source, s AS id, CAST(0 AS BIGINT) AS d FROM range(0, {{n}}) x(s) UNION SELECT b.source, e.dst, b.d + 1 FROM b JOIN e ON e.src = b.id WHERE b.d < 30),
dist AS (SELECT source, id, min(d) AS distance FROM b GROUP BY 1, 2)"""

_TRIANGLES = f"""WITH {EDGES},
tri AS (SELECT x.src AS a FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = x.src AND z.dst = y.dst)"""

_SETS = f"""WITH RECURSIVE {INFLUENCE},
p AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM tv),
n AS (SELECT count(*) AS n FROM p),
s AS (SELECT i AS set_id, id FROM range(0, {{sets}}) x(i) JOIN p ON p.place = {coin("i", "0", "0")} % (SELECT n FROM n)
  UNION SELECT s.set_id, w.dst FROM s JOIN w ON w.src = s.id WHERE {coin("s.set_id", "w.src", "w.dst")} <= w.weight * {float(MODULUS)})"""
SETS, PICKS = 1000, 5  # the reference's default run
PATH_VERTICES = 8


def _greedy(final: str | None = None) -> str:
    out = [_SETS.format(sets=SETS), "s0 AS (SELECT * FROM s)"]
    for k in range(PICKS):
        out.append(f"c{k} AS (SELECT {k} AS rank, id, count(*) AS frequency FROM s{k} GROUP BY id ORDER BY frequency DESC, id LIMIT 1)")
        out.append(f"s{k + 1} AS (SELECT * FROM s{k} WHERE set_id NOT IN (SELECT set_id FROM s{k} WHERE id IN (SELECT id FROM c{k})))")
    picks = " UNION ALL ".join(f"SELECT rank, id, frequency, (SELECT count(DISTINCT set_id) FROM s{PICKS - 1}) AS uninfluenced FROM c{k}" for k in range(PICKS))
    return ",\n".join(out) + (f",\npicks AS ({picks})\n{final}" if final else "\n" + picks)


_REPORT = """SELECT rank, picks.id, frequency, coalesce(degree, 0) AS degree, bought, sold, round(coalesce(influence, 0.0), 6) AS influence
FROM picks LEFT JOIN tr USING (id) LEFT JOIN (SELECT src AS id, count(*) AS degree, CAST(sum(CAST(weight AS DECIMAL(20, 12))) AS DOUBLE) AS influence FROM w GROUP BY 1) d USING (id)"""

#: largest first, each to the least loaded host, the least number among equals; the loads are the state.
_BALANCE = f"""WITH RECURSIVE {EDGES}, c AS (SELECT CAST(src % 64 AS INTEGER) AS vhost, count(*) AS edges FROM e GROUP BY 1),
o AS (SELECT vhost, edges, row_number() OVER (ORDER BY edges DESC, vhost) AS k FROM c),
g AS (SELECT CAST(0 AS BIGINT) AS k, CAST(NULL AS INTEGER) AS vhost, CAST(NULL AS BIGINT) AS edges, CAST(NULL AS INTEGER) AS host, [CAST(0 AS BIGINT) FOR x IN range(8)] AS load
  UNION ALL SELECT o.k, o.vhost, o.edges, CAST(list_position(load, list_min(load)) - 1 AS INTEGER), [load[i] + CASE WHEN i = list_position(load, list_min(load)) THEN o.edges ELSE 0 END FOR i IN range(1, 9)] FROM g JOIN o ON o.k = g.k + 1)
SELECT vhost, edges, host FROM g WHERE k > 0"""


def _features() -> str:
    code = lambda c: "CASE " + c + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in CODES.items()) + " END"
    return f"""WITH {CATALOGUE},
x AS (SELECT ce.src, ce.dst, {code("ce.type")} AS ec, {code("cv.type")} AS vc FROM ce JOIN cv ON cv.id = ce.dst),
h AS (SELECT src, {", ".join(f"sum((ec = {k})::BIGINT + (vc = {k})::BIGINT)::BIGINT AS c{k}" for k in range(30))} FROM x GROUP BY 1),
f AS (SELECT id, {", ".join(f"coalesce(c{k}, 0) AS c{k}" for k in range(30))} FROM cv LEFT JOIN h ON h.src = cv.id),
g AS (SELECT ce.src, {", ".join(f"sum(c{k})::BIGINT AS s{k}" for k in range(15))} FROM ce JOIN f ON f.id = ce.dst GROUP BY 1)
SELECT f.id, concat_ws(' ', {", ".join([f"c{k}" for k in range(15)] + [f"c{k} + coalesce(s{k - 15}, 0)" for k in range(15, 30)])}) AS features FROM f LEFT JOIN g ON g.src = f.id"""


def _sampled(seeds: str, fanouts: tuple[int, ...]) -> str:
    """Hashed neighbour samples t0, t1, ... (batch, level, src, dst), level by level from the rows (batch, src) of seeds."""
    out = [f"WITH {EDGES}", f"f0 AS ({seeds})"]
    for level, n in enumerate(fanouts):
        out.append(f"t{level} AS (SELECT batch, {level} AS level, src, dst FROM f{level} JOIN e USING (src) QUALIFY row_number() OVER (PARTITION BY batch, src ORDER BY {coin(str(level + 1), 'src', 'dst')}, dst) <= {n})")
        seen = " UNION ALL ".join(f"SELECT batch, src FROM f{k}" for k in range(level + 1))
        out.append(f"f{level + 1} AS (SELECT DISTINCT batch, dst AS src FROM t{level} ANTI JOIN ({seen}) s ON s.batch = t{level}.batch AND s.src = t{level}.dst)")
    return ",\n".join([*out, "taken AS (" + " UNION ALL ".join(f"SELECT * FROM t{k}" for k in range(len(fanouts))) + ")"])


_SAMPLES = _sampled("SELECT id % 64 AS batch, id AS src FROM v", (3, 2, 1)) + "\nSELECT * FROM taken"
_EGO = (
    _sampled("SELECT id AS batch, id AS src FROM v QUALIFY row_number() OVER (ORDER BY id) - 1 < count(*) OVER () // 4", (5, 3, 2, 1))
    + "\nSELECT batch AS root, src, dst FROM taken UNION SELECT batch, dst, src FROM taken UNION SELECT batch, src, src FROM taken UNION SELECT batch, dst, dst FROM taken UNION SELECT batch, src, src FROM f0"
)


def _beam(most: int, beam: int, k: int) -> str:
    out = [f"WITH {KNOWLEDGE}", "nrm AS (SELECT id, list_sum(list_transform(f, lambda x: abs(CAST(x AS DOUBLE)))) AS norm FROM k)", "st AS (SELECT DISTINCT src, dst, norm FROM ke JOIN nrm ON nrm.id = ke.dst)", "p0 AS (SELECT [id] AS path, id AS src, norm AS score FROM nrm WHERE id = 0)"]
    for i in range(most - 1):
        out.append(f"g{i} AS (SELECT path AS parent, list_append(path, dst) AS path, dst AS src, round(score + norm, 6) AS score FROM p{i} JOIN st USING (src) WHERE NOT list_contains(path, dst))")
        out.append(f"p{i + 1} AS (SELECT path, src, score FROM g{i} WHERE src <> 104 QUALIFY row_number() OVER (PARTITION BY parent ORDER BY score DESC, src) <= {beam})")
    found = " UNION ALL ".join(f"SELECT path, score FROM g{i} WHERE src = 104" for i in range(most - 1))
    return ",\n".join(out) + f"\nSELECT array_to_string(path, ' ') AS path, score FROM ({found}) ORDER BY score DESC, path LIMIT {k}"


_MIXED = f"SELECT id, {coin('0', 'id', '0')} AS h FROM tv"
_PLACED = f"mx AS ({_MIXED}), pl AS (SELECT id, row_number() OVER (ORDER BY h, id) - 1 AS place, count(*) OVER () AS n FROM mx), sp AS (SELECT id, place, CASE WHEN place < n // 4 THEN 'train' WHEN place < n // 4 + n // 8 THEN 'test' WHEN place < n // 4 + 2 * (n // 8) THEN 'valid' ELSE 'none' END AS split FROM pl)"

ORACLE_SQL = {
    "triangle_count": f"{_TRIANGLES} SELECT count(*) AS triangles FROM tri",
    "triangle_count_wedges": f"{_TRIANGLES} SELECT count(*) AS triangles FROM tri",
    "triangle_count_literal": f"{_TRIANGLES} SELECT count(*) AS triangles FROM tri",
    "triangle_chunks": f"{_TRIANGLES}, pl AS (SELECT id, CAST(floor(log2(row_number() OVER (ORDER BY id))) AS INTEGER) AS chunk FROM v), c AS (SELECT chunk, CAST(count(a) AS BIGINT) AS triangles FROM pl LEFT JOIN tri ON a = id GROUP BY 1) SELECT *, CAST(sum(triangles) OVER (ORDER BY chunk) AS BIGINT) AS running FROM c",
    "triangle_edge_chunks": f"WITH {EDGES}, tri AS (SELECT x.src AS a, x.dst AS b, count(*) AS n FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = x.src AND z.dst = y.dst GROUP BY 1, 2), pl AS (SELECT src, dst, CAST(floor(log2(row_number() OVER (ORDER BY src, dst))) AS INTEGER) AS chunk FROM e), c AS (SELECT chunk, CAST(coalesce(sum(n), 0) AS BIGINT) AS triangles FROM pl LEFT JOIN tri ON a = src AND b = dst GROUP BY 1) SELECT *, CAST(sum(triangles) OVER (ORDER BY chunk) AS BIGINT) AS running FROM c",
    "graph_size": f"WITH {EDGES} SELECT (SELECT count(*) FROM v) AS n_vertices, (SELECT count(*) FROM e) AS n_edges",
    "out_degree": f"WITH {EDGES} SELECT id, count(dst) AS degree FROM v LEFT JOIN e ON src = id GROUP BY 1",
    "in_degree": f"WITH {EDGES} SELECT id, count(src) AS degree FROM v LEFT JOIN e ON dst = id GROUP BY 1",
    "degree_histogram": f"WITH {EDGES}, d AS (SELECT id, count(dst) AS degree FROM v LEFT JOIN e ON src = id GROUP BY 1) SELECT degree, count(*) AS vertices FROM d GROUP BY 1",
    "adjacency_sorted": f"WITH {EDGES} SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS neighbours FROM e GROUP BY 1",
    "edge_window": f"WITH {EDGES}, n AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM e) SELECT src AS id, coalesce(string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) FILTER (WHERE k > 2 AND k <= 7), '') AS neighbours FROM n GROUP BY 1",
    "edge_at_offset": f"WITH {EDGES} SELECT src AS id, dst FROM e QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) = 3",
    "vertex_window": f"WITH {EDGES} SELECT id, row_number() OVER (ORDER BY id) - 1 AS index FROM v QUALIFY row_number() OVER (ORDER BY id) BETWEEN 11 AND 60",
    "transpose": f"WITH {EDGES} SELECT dst AS src, src AS dst FROM e",
    "mirror_list": f"WITH {EDGES} SELECT DISTINCT CAST(src % 8 AS INTEGER) AS host, dst AS id FROM e WHERE src % 8 <> dst % 8",
    "host_counts": f"WITH {EDGES} SELECT CAST(id % 8 AS INTEGER) AS Host, 'Vertices' AS Category, count(*) AS Count FROM v GROUP BY 1 UNION ALL SELECT CAST(src % 8 AS INTEGER), 'Edges', count(*) FROM e GROUP BY 1",
    "record_dispatch": f"WITH {RECORDS} SELECT src_type, type, dst_type, count(*) AS edges, CAST(sum(src) AS BIGINT) AS src_sum, CAST(sum(dst) AS BIGINT) AS dst_sum FROM both_ GROUP BY 1, 2, 3",
    "record_vertices": f"WITH {CATALOGUE} SELECT type, count(*) AS vertices, CAST(sum(id // 8) AS BIGINT) AS id_sum FROM cv GROUP BY 1",
    "undeclared_endpoints": f"WITH {CATALOGUE} SELECT count(*) AS undeclared FROM (SELECT src AS id, 0 FROM ce0 WHERE src NOT IN (SELECT id FROM cv) UNION SELECT dst, 1 FROM ce0 WHERE dst NOT IN (SELECT id FROM cv))",
    "inverse_union": f"WITH {TRADE} SELECT src, dst, topic, type, amount FROM t",
    "diropt_edges": f"WITH {TRADE} SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM t",
    "exchange_edges": f"WITH {TRADE} SELECT DISTINCT CAST(least(src, dst) % 4 AS INTEGER) AS bucket, least(src, dst) AS src, greatest(src, dst) AS dst FROM t WHERE src <> dst",
    "virtual_host_counts": f"WITH {EDGES} SELECT CAST(src % 64 AS INTEGER) AS vhost, count(*) AS edges FROM e GROUP BY 1",
    "round_robin_hosts": f"WITH {EDGES}, c AS (SELECT CAST(src % 64 AS INTEGER) AS vhost, count(*) AS edges FROM e GROUP BY 1) SELECT vhost, edges, CAST((row_number() OVER (ORDER BY edges, vhost) - 1) % 8 AS INTEGER) AS host FROM c",
    "accumulator": "SELECT CAST(sum(l_quantity) AS BIGINT) AS total FROM lineitem",
    "project_sales": f"WITH {TRADE} SELECT src, dst, type, amount FROM t WHERE topic = 13 AND amount > 0 AND src % 5 <> 0 AND dst % 5 <> 0",
    "project_drop_edgeless": f"WITH {TRADE} SELECT id, 'PERSON' AS type FROM tv WHERE id IN (SELECT src FROM t WHERE topic = 13 AND amount > 0 AND src % 5 <> 0 AND dst % 5 <> 0)",
    "project_relations": f"WITH {KNOWLEDGE} SELECT src, dst, CAST(type AS BIGINT) AS type, mirror FROM ke WHERE type IN (207, 40)",
    "entity_label": f"WITH {KNOWLEDGE}, s AS (SELECT src AS id, bool_or(type = 207 AND NOT mirror) AS p, bool_or(type = 40 AND mirror) AS u FROM ke GROUP BY 1) SELECT k.id, CASE WHEN p THEN 'PERSON' WHEN u THEN 'UNIVERSITY' ELSE 'NONE' END AS entity FROM k LEFT JOIN s USING (id)",
    "prefix_sum": "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS running FROM orders",
    "neighbor_min_sync": f"WITH {EDGES}, m AS (SELECT dst AS id, min(src) AS m FROM e GROUP BY 1) SELECT v.id, least(v.id, coalesce(m, v.id)) AS value, coalesce(m < v.id, false) AS changed FROM v LEFT JOIN m ON m.id = v.id",
    "neighbor_sum": f"WITH {EDGES} SELECT dst AS id, CAST(sum(src) AS BIGINT) AS value FROM e GROUP BY 1",
    "mirror_broadcast": f"WITH {EDGES}, m AS (SELECT dst AS id, min(src) AS m FROM e GROUP BY 1) SELECT DISTINCT CAST(e.src % 8 AS INTEGER) AS host, e.dst AS id, CASE WHEN m.m < e.dst THEN m.m ELSE e.dst END AS value, false AS dirty FROM e JOIN m ON m.id = e.dst WHERE e.src % 8 <> e.dst % 8",
    "topk_degree": f"WITH {EDGES} SELECT src AS id, count(*) AS degree FROM e GROUP BY 1 ORDER BY degree DESC, id LIMIT 25",
    "topk_neighbours": f"WITH {TRADE} SELECT src, dst, amount FROM t WHERE type = 'SALE' QUALIFY row_number() OVER (PARTITION BY src ORDER BY amount DESC, dst) <= 3",
    "argmax_degree": f"WITH {EDGES} SELECT src AS id, count(*) AS degree FROM e GROUP BY 1 ORDER BY degree DESC, id LIMIT 1",
    "sorted_edges": f"WITH {EDGES} SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS place FROM e",
    "lower_bound": f"WITH {EDGES}, v2 AS (SELECT id FROM v WHERE id IN (SELECT src FROM e)) SELECT id, CAST(count(dst) FILTER (WHERE dst < 100) AS INTEGER) AS place FROM v2 JOIN e ON src = id GROUP BY 1",
    "common_neighbors": f"WITH {EDGES} SELECT x.src AS a, x.dst AS b, count(y.dst) AS common FROM e x LEFT JOIN (e y JOIN e z ON y.dst = z.dst) ON y.src = x.src AND z.src = x.dst WHERE x.src IN (SELECT src FROM e) AND x.dst IN (SELECT src FROM e) GROUP BY 1, 2",
    "edge_probe": f"WITH {EDGES}, q AS (SELECT DISTINCT dst AS src, dst + 1 AS dst FROM e) SELECT q.src, q.dst, e.src IS NOT NULL AS connected FROM q LEFT JOIN e ON e.src = q.src AND e.dst = q.dst",
    "bfs_levels": f"{BFS.format(n=1)} SELECT id, distance FROM dist",
    "bfs_push_pull": f"{BFS.format(n=1)} SELECT id, distance FROM dist",
    "bfs_multi_source": f"{BFS.format(n=4)} SELECT source, id, distance FROM dist",
    "bfs_unreached": f"{BFS.format(n=1)} SELECT v.id, dist.distance FROM v LEFT JOIN dist ON dist.id = v.id",
    "bfs_edges_traversed": f"{BFS.format(n=1)}, o AS (SELECT src, count(*) AS n FROM e GROUP BY 1) SELECT source, distance AS level, count(*) AS frontier, CAST(coalesce(sum(n), 0) AS BIGINT) AS edges FROM dist LEFT JOIN o ON src = id GROUP BY 1, 2",
    "sssp_relax": f"{BFS.format(n=1)} SELECT id, distance FROM dist",
    "sssp_weighted": f"WITH RECURSIVE {EDGES}, b AS (SELECT CAST(0 AS BIGINT) AS id, CAST(0 AS BIGINT) AS d UNION SELECT e.dst, b.d + 1 + (e.src * 31 + e.dst * 17) % 5 FROM b JOIN e ON e.src = b.id WHERE b.d < 45) SELECT id, min(d) AS distance FROM b GROUP BY 1",
    "sold_bought": f"WITH {INFLUENCE} SELECT id, sold, bought, bought AS desired FROM tr",
    "edge_probability": f"WITH {INFLUENCE} SELECT src, dst, type, topic, round(weight, 9) AS weight FROM w",
    "influence_totals": f"WITH {INFLUENCE} SELECT round(CAST(sum(CAST(weight AS DECIMAL(20, 12))) AS DOUBLE), 4) AS total_weight, CAST(sum(CAST(amount AS DECIMAL(18, 4))) AS DOUBLE) AS total_amount FROM w",
    "rrr_sets": f"{_SETS.format(sets=SETS)} SELECT set_id, id FROM s",
    "vertex_frequency": f"{_SETS.format(sets=SETS)} SELECT id, count(*) AS frequency FROM s GROUP BY 1",
    "influential_nodes": _greedy(),
    "transe_topk": f"WITH {KNOWLEDGE}, h AS (SELECT f FROM k WHERE id = 0), r AS (SELECT f FROM k WHERE id = 207) SELECT k.id, {_score('h.f', 'r.f', 'k.f')} AS score FROM k, h, r ORDER BY score DESC, id LIMIT 50",
    "rerank": f"WITH {KNOWLEDGE}, h AS (SELECT f FROM k WHERE id = 0), r AS (SELECT f FROM k WHERE id = 207), c AS (SELECT k.id, {_score('h.f', 'r.f', 'k.f')} AS score FROM k, h, r ORDER BY score DESC, id LIMIT 50), h2 AS (SELECT f FROM k WHERE id = 1), r2 AS (SELECT f FROM k WHERE id = 3) SELECT k.id, {_score('h2.f', 'r2.f', 'k.f')} AS score FROM k, h2, r2 WHERE id IN (SELECT id FROM c)",
    "reasoning_chain": f"WITH {KNOWLEDGE}, h AS (SELECT f FROM k WHERE id = 0), r AS (SELECT f FROM k WHERE id = 207), c AS (SELECT k.id, k.f, {_score('h.f', 'r.f', 'k.f')} AS score FROM k, h, r WHERE label <> 2 ORDER BY score DESC, id LIMIT 50), h2 AS (SELECT f FROM k WHERE id = 1), r2 AS (SELECT f FROM k WHERE id = 3), r3 AS (SELECT f FROM k WHERE id = 40), p AS (SELECT c.id AS person, {_score('h2.f', 'r2.f', 'c.f')} AS person_score FROM c, h2, r2), u AS (SELECT c.id AS person, k.id AS place, {_score('c.f', 'r3.f', 'k.f')} AS place_score FROM c, r3, k WHERE k.label = 2 QUALIFY row_number() OVER (PARTITION BY c.id ORDER BY place_score DESC, k.id) = 1) SELECT person, person_score, place, place_score FROM p JOIN u USING (person)",
    "beam_paths": _beam(PATH_VERTICES, 3, 10),
    "two_hop_features": _features(),
    "split_masks": f"WITH {TRADE}, {_PLACED} SELECT id, place, split FROM sp",
    "minibatches": f"WITH {TRADE}, {_PLACED} SELECT id, (row_number() OVER (ORDER BY {coin('2', 'id', '1')}, id) - 1) // 128 AS batch FROM sp WHERE split = 'train'",
    "neighbor_samples": _SAMPLES,
    "ego_graphs": _EGO,
    "edge_balance": _BALANCE,
    "influence_report": _greedy(_REPORT),
    "softmax_rows": f"WITH {KNOWLEDGE}, x AS (SELECT id, [exp(CAST(y AS DOUBLE) - list_max(f)) FOR y IN f] AS e FROM k) SELECT id, CAST(i - 1 AS INTEGER) AS place, round(e[i] / list_sum(e), 6) AS p FROM x, range(1, 65) r(i)",
    "link_prediction": f"WITH {KNOWLEDGE} SELECT DISTINCT x.id AS a, y.id AS b, round(1.0 / (1.0 + exp(-list_sum(list_transform(range(1, 65), lambda i: CAST(x.f[i] AS DOUBLE) * CAST(y.f[i] AS DOUBLE))))), 6) AS score FROM ke JOIN k x ON x.id = src JOIN k y ON y.id = dst",
    "spmm": "SELECT l_partkey AS row, CAST(c AS INTEGER) AS col, CAST(sum(CAST(l_quantity * f AS DECIMAL(28, 8))) AS DOUBLE) AS value FROM lineitem JOIN (SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS f, 0 AS c FROM supplier UNION ALL SELECT s_suppkey, CAST(s_suppkey % 7 AS DOUBLE), 1 FROM supplier) s ON s_suppkey = l_suppkey GROUP BY 1, 2",
    "stream_triad": "SELECT o_orderkey, o_totalprice AS copied, round(3.0 * o_totalprice, 4) AS scaled, round(o_totalprice + o_custkey, 4) AS added, round(o_totalprice + 3.0 * o_custkey, 4) AS triad FROM orders",
    "random_updates": f"WITH u AS (SELECT {coin('2', 'i', '0')} % 1024 AS slot, {coin('3', 'i', '0')} AS u FROM range(0, 20000) x(i)), m AS (SELECT slot, bit_xor(u) AS u FROM u GROUP BY 1) SELECT s AS slot, xor(s, coalesce(u, 0)) AS value FROM range(0, 1024) y(s) LEFT JOIN m ON m.slot = s",
}
