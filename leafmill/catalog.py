"""Queries of the core and their DuckDB SQL."""

from leafmill.plans import card_texts, documents, relational, reviews, streams

_ALL = (documents, reviews, card_texts, relational, streams)
QUERIES: dict = {name: q for plan in _ALL for name, q in plan.QUERIES.items()}
ORACLES: dict = {name: sql for plan in _ALL for name, sql in plan.ORACLES.items()}
