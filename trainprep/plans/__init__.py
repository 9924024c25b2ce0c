"""End-to-end plans (pretraining, chat, preference, evaluation) and the
registered queries with their DuckDB oracles."""
