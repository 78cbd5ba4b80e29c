"""Imports every query module, so that the catalog is filled."""

from . import q_consensus, q_corpus, q_diversity, q_drafts, q_evaluation, q_facts, q_graph, q_lookups, q_menus, q_picks, q_records, q_routes, q_scoring, q_service, q_sources, q_state, q_text, q_turns  # noqa: F401
