"""Importers on small files with known contents."""

import pytest
from conftest import ordered, rows

from lattix.functions import scalars
from lattix.graph import UndeclaredEndpoint
from lattix.operators.sets import direction_optimised
from lattix.plans import triangles
from lattix.sources import edge_lists, records, sinks, traces

from pyspark.sql import functions as F

# The small graph whose adjacency and triangle count are known, in the order of its file.
SIMPLE = [
    "8 5", "5 0", "7 9", "8 2", "3 1", "5 3", "2 1", "8 3", "4 0", "5 1",
    "4 3", "0 3", "4 4", "3 6", "5 5", "4 0", "3 8", "2 5", "3 3", "0 1",
]
REPEATS = SIMPLE[:1] * 2 + ["5 0", "0 5"] + SIMPLE[2:]


def write(tmp_path, name, lines):
    path = tmp_path / name
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def text(spark, lines):
    return spark.createDataFrame([(x,) for x in lines], "value string")


def test_adjacency_of_a_file(spark, tmp_path):
    out = dict(rows(edge_lists.read_adjacency(spark, write(tmp_path, "simple.el", SIMPLE), 10)))
    assert out == {0: [1, 3], 1: [], 2: [1, 5], 3: [1, 3, 6, 8], 4: [0, 0, 3, 4], 5: [0, 1, 3, 5], 6: [], 7: [9], 8: [2, 3, 5], 9: []}


def test_adjacency_in_the_order_of_the_lines(spark, tmp_path):
    out = dict(rows(edge_lists.read_adjacency(spark, write(tmp_path, "simple.el", SIMPLE), 10, as_read=True)))
    assert out == {0: [3, 1], 1: [], 2: [1, 5], 3: [1, 6, 8, 3], 4: [0, 3, 4, 0], 5: [0, 3, 1, 5], 6: [], 7: [9], 8: [5, 2, 3], 9: []}


def test_lists_are_made_of_the_wanted_vertices_only(spark, tmp_path):
    lines = ["1 50", "2 1", "50 1", "99 2", "1\t3", " 1 ,, 2 9", "2 x", "1_0 4", "-1 2", "1 -2", "1.5 2", "2 007", "2", ",", "1 99999999999999999999"]
    path = write(tmp_path, "few.el", lines)
    for as_read in (False, True):
        found = edge_lists.read_adjacency(spark, path, 3, as_read=as_read)
        assert dict(rows(found)) == {0: [], 1: [50, 3, 2] if as_read else [2, 3, 50], 2: [1, 7]}
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "< 3" in plan.split("Aggregate")[1], plan


def test_direction_optimised_adjacency(spark, tmp_path):
    out = dict(rows(edge_lists.read_adjacency(spark, write(tmp_path, "repeats.el", REPEATS), 10, direction_optimise=True)))
    assert [out[k] for k in range(6)] == [[1, 3, 4, 5], [2, 3, 5], [5, 8], [3, 4, 5, 6, 8], [4], [5, 8]]
    assert out[7] == [9] and out[6] == out[8] == out[9] == []


def test_bounded_scan_drops_garbage(spark, tmp_path):
    path = write(tmp_path, "x.el", ["0 1", "1_0 2", "x 3", "5 99", "", "# 1 2", "7", "3\t4"])
    assert rows(edge_lists.read_edges(spark, path, 20)) == [(0, 1), (3, 4), (10, 2)]
    assert rows(edge_lists.read_graph(spark, path, 5).sizes()) == [(5, 2)]


def test_triangles_of_files(spark, tmp_path):
    edges = edge_lists.read_edges(spark, write(tmp_path, "simple.el", SIMPLE))
    assert rows(triangles.triangle_count(edges)) == [(8,)]
    assert rows(triangles.triangle_count_by_wedges(edges)) == [(8,)]
    assert edges.count() == 20 and edges.distinct().count() == 19
    assert direction_optimised(edges, self_loops=False).count() == 15


def test_exchange(spark):
    edges = spark.createDataFrame([(5, 2), (2, 5), (3, 3), (1, 4)], "src long, dst long")
    assert rows(edge_lists.exchange_edges(edges, 2)) == [(0, 2, 5), (1, 1, 4)]


def test_sorted_edges_make_vertices(spark):
    g = edge_lists.from_sorted_edges(spark.createDataFrame([(1, 2), (1, 3), (3, 1)], "src long, dst long"))
    assert rows(g.out_degrees()) == [(1, 2), (2, 0), (3, 1)]
    assert rows(edge_lists.from_adjacency(g.adjacency()).edges) == [(1, 2), (1, 3), (3, 1)]


@pytest.mark.parametrize("kind", ["general", "symmetric"])
def test_matrix_market(spark, tmp_path, kind):
    path = write(tmp_path, "m.mtx", [f"%%MatrixMarket matrix coordinate real {kind}", "% remark", "3 3 2", "1 2 0.5", "3 3 2"])
    head, edges = edge_lists.read_matrix_market(spark, path)
    assert head == {"rows": 3, "columns": 3, "entries": 2, "symmetric": kind == "symmetric", "field": "real"}
    expected = [(0, 1, 0.5), (2, 2, 2.0)] + ([(1, 0, 0.5), (2, 2, 2.0)] if kind == "symmetric" else [])
    assert rows(edges) == ordered(expected)


def test_matrix_market_pattern_and_refusal(spark, tmp_path):
    _, edges = edge_lists.read_matrix_market(spark, write(tmp_path, "p.mtx", ["%%MatrixMarket matrix coordinate pattern general", "2 2 1", "2 1"]))
    assert rows(edges) == [(1, 0, 1.0)]
    with pytest.raises(ValueError):
        edge_lists.read_matrix_market(spark, write(tmp_path, "q.mtx", ["%%MatrixMarket matrix array real general", "1 1"]))


def test_features(spark, tmp_path):
    assert rows(edge_lists.read_features(spark, write(tmp_path, "f", ["1 2.5", "3 4"]))) == [(0, [1.0, 2.5]), (1, [3.0, 4.0])]


# ---- records

VERTICES = [f"Person,{i},,,,,,,," for i in range(1, 9)] + [f"Publication,,,,,{i},,4/1/2013,," for i in range(101, 106)] + [f"Topic,,,,,,{i},,," for i in (201, 202, 203)]
AUTHORS = [f"Author,{p},,,,{b},,,," for p, b in ((1, 101), (1, 102), (1, 103), (1, 104), (1, 105), (2, 102), (3, 103), (4, 104), (5, 105))]
TOPICS = [f"HasTopic,,,,,{b},{t},,," for b, t in ((101, 201), (101, 202), (102, 203), (103, 201), (104, 202), (104, 203), (105, 202))]


def test_record_graph(spark):
    g = records.record_graph(text(spark, VERTICES + AUTHORS + TOPICS))
    assert rows(g.sizes()) == [(16, 32)]
    kinds = {(r["type"], r["src_type"], r["dst_type"]): r["count"] for r in g.edges.groupBy("type", "src_type", "dst_type").count().collect()}
    assert kinds == {("AUTHOR", "PERSON", "PUBLICATION"): 9, ("WRITTENBY", "PUBLICATION", "PERSON"): 9, ("HASTOPIC", "PUBLICATION", "TOPIC"): 7, ("TOPICIN", "TOPIC", "PUBLICATION"): 7}


def test_record_endpoints_are_the_first_filled_field(spark):
    lines = ["Author,1,,7,8,9,,,,", "Author,1,,,8,9,,,,", "Author,1,,,,9,,,,", "Includes,,,7,8,,,,,", "HasOrg,,,,,9,6,,,", "Sale,1,2,,,,,,,", "HasTopic,,,,8,,6,,,", "Sale,3"]
    out = rows(records.record_edges(text(spark, lines), inverse=False))
    assert set(out) == {(1, 7, "AUTHOR", "PERSON", "FORUM"), (1, 8, "AUTHOR", "PERSON", "FORUMEVENT"), (1, 9, "AUTHOR", "PERSON", "PUBLICATION"), (7, 8, "INCLUDES", "FORUM", "FORUMEVENT"), (9, 6, "HASORG", "PUBLICATION", "TOPIC"), (1, 2, "SALE", "PERSON", "PERSON"), (8, 6, "HASTOPIC", "FORUMEVENT", "TOPIC"), (3, 0, "SALE", "PERSON", "PERSON")}


def test_strict_records(spark):
    with pytest.raises(records.UnknownRecord):
        records.record_graph(text(spark, ["Widget,1,,,,,,,,"]))
    with pytest.raises(UndeclaredEndpoint):
        records.record_graph(text(spark, ["Person,1,,,,,,,,", "Sale,1,2,,,,,,,"]))
    assert rows(records.record_graph(text(spark, ["Person,1,,,,,,,,", "Sale,1,2,,,,,,,", "Widget"]), strict=False).sizes()) == [(1, 0)]


def test_network_files(spark, tmp_path):
    # Sample rows whose edges are known.
    paths = {
        "commercial": write(tmp_path, "commercial", ["Sale,299156,458364,8486,,,,3.0366367403882406", "invalid,1,2,3,,,,4", "Sale,1552474,1928788,,8/21/2018,,,", "Author,1,2,,,,,"]),
        "cyber": write(tmp_path, "cyber", ["0,217661,172800,0,6,26890,94857,6,5,1379,1770"]),
        "social": write(tmp_path, "social", ["5,679697"]),
        "uses": write(tmp_path, "uses", ["12,311784"]),
    }
    edges = records.read_network(spark, **paths)
    got = {(r["src"], r["dst"], r["type"]): r for r in edges.collect()}
    assert len(got) == 12
    sale = got[299156, 458364, "SALE"]
    assert (sale["amount"], sale["topic"]) == (3.0366367403882406, 8486)
    assert got[458364, 299156, "PURCHASE"]["amount"] == sale["amount"]
    assert (got[1552474, 1928788, "SALE"]["amount"], got[1552474, 1928788, "SALE"]["topic"]) == (0.0, 0)
    assert (1, 2, "AUTHOR") in got and (2, 1, "WRITTENBY") in got
    cyber = got[0, 217661, "COMMUNICATION"]
    assert [cyber[c] for c in ("epoch_time", "duration", "protocol", "src_port", "dst_port", "src_packets", "dst_packets", "src_bytes", "dst_bytes")] == [172800, 0, 6, 26890, 94857, 6, 5, 1379, 1770]
    assert (217661, 0, "NONE") in got and (679697, 5, "NONE") in got
    assert got[311784, 12, "NONE"]["src_type"] == "DEVICE"
    assert (12, "PERSON") in rows(records.network_vertices(edges)) and (12, "DEVICE") not in rows(records.network_vertices(edges))


def test_reasoning_files(spark):
    assert rows(records.embedding_rows(text(spark, [",0,1", "7,0.5,-1.25"]), 2)) == [(7, [0.5, -1.25])]
    assert rows(records.relation_features(text(spark, ["7,0.5", "40,1"]), length=1)) == [(40, [1.0])]
    assert rows(records.relation_edges(text(spark, ["0,5,207,6"]))) == [(5, 6, 207, False), (6, 5, 207, True)]


# ---- scalars, sinks, traces


def test_parsing(spark):
    df = text(spark, ["12", "", "x", "4/1/2013", "-1.5e3"])
    c = F.col("value")
    assert [r[0] for r in df.select(scalars.whole_number(c)).collect()] == [12, 0, 0, 0, 0]
    assert [r[0] for r in df.select(scalars.leading_number(c)).collect()] == [12.0, 0.0, 0.0, 4.0, -1500.0]
    assert [r[0] for r in df.select(scalars.fixed_point(c)).collect()] == [12.0, None, None, None, None]
    assert [str(r[0]) for r in df.select(scalars.us_date(c)).collect()] == ["None"] * 3 + ["2013-04-01", "None"]


def test_coin_is_uniform_and_exact(spark):
    def h(s, a, b, seed=9801):
        return ((((s * 69621 + a * 48271) % 2147483647) * 40692 + b * 16807 + seed) % 2147483647) * 48271 % 2147483647

    df = spark.range(3000).select("id", scalars.coin(F.col("id") % 7, F.col("id"), F.lit(3)).alias("h"))
    got = df.collect()
    assert all(r["h"] == h(r["id"] % 7, r["id"], 3) for r in got)
    assert 0.45 < sum(r["h"] for r in got) / len(got) / 2147483647 < 0.55


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 2.0], [0.5, 0.5], [1.0, 4.0])], "h array<double>, r array<double>, t array<double>")
    h, r, t = F.col("h"), F.col("r"), F.col("t")
    assert df.select(scalars.translation_score(h, r, t), scalars.dot(h, t), scalars.l1_norm(t)).first()[:] == (1.0 - 0.5 - 1.5, 9.0, 5.0)
    assert abs(sum(df.select(scalars.softmax(t)).first()[0]) - 1) < 1e-12


def test_sinks(spark, tmp_path):
    g = edge_lists.read_graph(spark, write(tmp_path, "simple.el", SIMPLE), 10)
    sinks.write_host_counts(g, 2, str(tmp_path / "counts"))
    back = spark.read.csv(str(tmp_path / "counts"), header=True)
    assert back.columns == ["Host", "Category", "Count"]
    assert sum(int(r["Count"]) for r in back.filter("Category = 'Edges'").collect()) == 20
    sinks.write_adjacency(g, str(tmp_path / "adjacency"))
    assert spark.read.text(str(tmp_path / "adjacency")).count() == 10
    times = {}
    with sinks.timed("x", times):
        pass
    assert times["x"] >= 0


def test_traces(spark):
    lines = ["Phase 0", "Source Node 1", "LOAD (count): 5", "LOAD (bytes): 40", "ATOMIC_STORE (count): 2", "Phase 1", "Source Node 0", "STORE (count): 3", "LOAD (count): 1"]
    trace = spark.createDataFrame([(0, k, x) for k, x in enumerate(lines)], "host int, line_no int, value string")
    assert rows(traces.memory_summary(trace)) == [(0, 0, 1, "load", 5, 40), (0, 0, 1, "rmw", 2, 0), (0, 1, 0, "load", 1, 0), (0, 1, 0, "store", 3, 0)]
    stats = spark.createDataFrame([("core_2_pod_pxn1", "bfs_stall_cycles", 7), ("core_2_pod_pxn1", "bfs_busy_cycles", 5), ("command_0_x_pxn0", "bfs_stall_cycles", 9)], "component string, statistic string, value long")
    assert rows(traces.cycle_summary(stats, "bfs")) == [(1, 2, 7, 5, 12)]
