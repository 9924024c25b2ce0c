"""Imports every query module so that all queries are registered."""

from trainprep.plans import q_chat, q_corpus, q_eval, q_io  # noqa: F401
