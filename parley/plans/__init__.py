"""Registered queries (one per operator of the inventory) and their oracles."""

from parley.plans import flows, q_audio, q_dialogue, q_episode, q_requests, q_sources, q_streaming, q_text  # noqa: F401
from parley.plans.registry import ORACLES, QUERIES  # noqa: F401
