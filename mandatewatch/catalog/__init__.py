"""All registered queries."""

from mandatewatch.catalog import evaluation, graphs, models, pairing, quality, risk, sessions, similarity, texts
from mandatewatch.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "evaluation", "graphs", "models", "pairing", "quality", "risk", "sessions", "similarity", "texts"]
