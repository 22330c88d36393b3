"""Named queries over the input tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from docmill.plans import corpora, retrieval, stored

QUERIES = {**retrieval.QUERIES, **stored.QUERIES, **corpora.QUERIES}
ORACLES = {**retrieval.ORACLES, **stored.ORACLES, **corpora.ORACLES}
