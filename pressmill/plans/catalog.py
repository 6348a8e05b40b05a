"""The registered queries and their SQL twins."""

from __future__ import annotations

from . import graphs, links, scores, texts

QUERIES = links.QUERIES | texts.QUERIES | scores.QUERIES | graphs.QUERIES
ORACLE = links.ORACLE | texts.ORACLE | scores.ORACLE | graphs.ORACLE
