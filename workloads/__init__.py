"""Registered queries over the star-schema tables."""

from workloads import answering, profiles, requests, scores, sentences, shapes, sources  # noqa: F401
from workloads.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
