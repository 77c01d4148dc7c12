"""All queries of the library: name -> (spark, sf_dir) -> DataFrame, and the oracles."""

from __future__ import annotations

from . import composed, learning, quality, reports, samples, walks

_PARTS = (quality, samples, reports, learning, walks, composed)
QUERIES: dict = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLES: dict = {k: v for part in _PARTS for k, v in part.ORACLES.items()}
