"""Workload queries against their SQL in DuckDB."""

import os

import duckdb
import pytest

from weftgraph import workload

DATA = "/root/testdata/sf0.001"
SOME = ("scan_filter_project", "expr_case", "fn_lpad", "fn_json_extract", "agg_distinct", "join_3hop", "join_cycle", "join_optional", "varlen_1_3", "sort_nulls", "algo_pagerank", "algo_wcc", "vector_l2", "fts_bm25", "dml_set", "delta_merge", "rdf_infer", "rdf_load", "rdf_escapes", "rdf_types", "rdf_stats", "join_two_types", "optional_rel_var", "exists_rel_var", "count_rel_var", "exists_or", "dml_delete", "dml_delete_left", "dml_delete_both", "dml_delete_parallel", "dml_set_left", "dml_set_types", "dml_merge_rel", "apply_delta_nodes", "apply_delta_edges", "rows_api", "save_open", "stream_into", "copy_arrow", "ddl_drop", "vector_each", "vector_call", "fts_call", "fts_must", "export_import", "call_pagerank")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    out = duckdb.connect()
    for name in os.listdir(DATA):
        out.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{name}')")
    return out


def rows(columns, data):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in data), key=repr)


@pytest.mark.parametrize("name", SOME)
def test_same_rows(spark, con, name):
    df = workload.queries()[name](spark, DATA)
    cur = con.execute(workload.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, ([r[c] for c in names] for r in df.collect())) == rows(names, cur.fetchall())


def test_every_query_has_a_name_and_most_have_sql():
    assert set(workload.oracle_sql()) <= set(workload.queries()) and len(workload.oracle_sql()) > 130
    assert set(workload.HEADLINE) <= set(workload.queries())


WHOLE = ("varlen_1_2", "varlen_min2", "varlen_left", "varlen_both", "varlen_fixed", "varlen_filtered", "shortest_path", "shortest_path_ends", "shortest_path_pairs")


@pytest.mark.parametrize("name", WHOLE)
def test_whole_graph(spark, con, name):
    test_same_rows(spark, con, name)


def knows_of(spark):
    return {(r["a"], r["b"]) for r in workload.knows(spark, DATA).collect()}


def depths(edges, source):
    out, level = {source: 0}, [source]
    while level:
        further = {b for a, b in edges if a in level} - out.keys()
        out |= dict.fromkeys(further, max(out.values()) + 1)
        level = further
    return out


def test_shortest_paths_between_all(spark, con):
    edges = knows_of(spark)
    nodes = {a for a, _ in edges}  # every customer knows somebody; the one key beyond them that is known isn't a customer
    want = {(a, b, d) for a in nodes for b, d in depths(edges, a).items() if 1 <= d <= 4 and b in nodes}
    got = [tuple(r) for r in workload.queries()["shortest_path"](spark, DATA).select("a", "b", "d").collect()]
    assert len(got) == len(want) and set(got) == want and max(a for a, _, _ in got) > 60


def test_betweenness_of_the_whole_graph(spark, con):
    edges = knows_of(spark)
    nodes = {x for e in edges for x in e}
    out = {a: [y for x, y in edges if x == a] for a in nodes}
    depth, ways = {}, {}
    for s in nodes:
        depth[s], ways[s] = depths(edges, s), {s: 1}
        for v in sorted(depth[s], key=depth[s].get):
            for w in out[v]:
                if depth[s][w] == depth[s][v] + 1:
                    ways[s][w] = ways[s].get(w, 0) + ways[s][v]
    want = {v: sum(ways[s][v] * ways[v][t] / ways[s][t] for s in nodes if v in depth[s] and v != s for t in depth[s] if t not in (s, v) and t in depth[v] and depth[s][v] + depth[v][t] == depth[s][t]) for v in nodes}
    got = {r["node_id"]: r["centrality"] for r in workload.queries()["algo_betweenness"](spark, DATA).collect()}
    assert got.keys() == want.keys() and max(got) > 50 and all(abs(got[v] - want[v]) < 1e-5 for v in nodes)
