"""Queries against their SQL over the smallest tables, and the borders between the parts of the library."""

import re
from pathlib import Path

import pytest

from grafloom.plans import oracle
from grafloom.queries import data_processing, data_processing_sql, graph, graph_sql, language

QUERIES = data_processing.QUERIES | graph.QUERIES | language.QUERIES
SQL = data_processing_sql.SQL | graph_sql.SQL | language.SQL
SOME = [
    "p2_found", "p2_report", "p3_found", "p4_found", "p4_totals", "p5_plan", "join_null_safe", "agg_all_kernels", "topk_sorted", "overlap_topk", "top_edges_per_node", "reachability", "k_hop_nodes", "infer_transitive", "knn_join",
    "token_index", "bundle_diff", "match_filter_project", "two_hop_edge_properties", "relation_union", "optional_match", "with_aggregate_filter", "var_length_match", "subclassof", "exists_pattern", "as_of_query",
]


@pytest.mark.parametrize("name", SOME)
def test_same_rows_as_sql(spark, sf_dir, name):
    con = oracle.duck(sf_dir)
    assert oracle.differences(QUERIES[name](spark, sf_dir).toArrow(), con.execute(SQL[name]).to_arrow_table()) == ""


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_nothing_outside_imports_llm():
    root = Path(__file__).resolve().parents[1]
    for p in (root / "grafloom").rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s+grafloom\.llm", p.read_text(), re.MULTILINE), p


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
