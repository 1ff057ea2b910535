"""Query plans: operators put together over the project's tables, with their DuckDB SQL."""
