"""Queries over the exact graph make it once; a second time would double the part that grows with the square of the vectors."""

import pytest

from gridvane import catalogue

from .conftest import SF

NAMES = [
    "layout_dbeam_estar_split",  # F2
    "layout_cooccur_star",  # F3
    "layout_dir_edge_star",  # F4
    "layout_directed_beam_dual",  # F5
    "layout_directed_beam",  # F6
    "layout_directed_beam_hybrid",  # F7
    "layout_directed_beam_inseed",  # F8
    "layout_directed_beam_pct100",  # F9
    "layout_directed_beam_pct50",  # F10
    "layout_directed_beam_pct90",  # F11
    "layout_directed_beam_pct30",  # F12
    "layout_directed_beam_starfill",  # F13
    "layout_directed_beam_pct80",  # F14
    "layout_directed_beam_top4first",  # F15
    "layout_directed_seed_replica",  # F16
    "layout_edge",  # F17
    "layout_directed_star",  # F18
    "layout_edge_clique",  # F19
    "layout_edge_dir",  # F20
    "layout_edge_pair",  # F21
    "layout_edge_star",  # F22
    "layout_frontier",  # F23
    "layout_directed_beam_tight",  # F26
    "relayout_permutation",  # F31
    "undirected_adjacency",  # F32
    "bfs_levels",  # F33
    "profile_counters",  # F34
    "benefit_density",  # F35
    "seed_nbr_sweep_cut",  # F36
    "layout_seed_replica_pct30",  # F37
    "profile_cdf",  # F38
    "profile_edges",  # F42
    "layout_seed_benefit_pct80",  # F43
]


@pytest.fixture(scope="module")
def made(spark):
    return catalogue.edges(spark, SF)


@pytest.mark.parametrize("name", NAMES)
def test_graph_is_made_once(spark, monkeypatch, made, name):
    calls = []
    monkeypatch.setattr(catalogue, "edges", lambda *a: calls.append(a) or made)
    assert catalogue.QUERIES[name](spark, SF).count() > 0
    assert len(calls) == 1
