"""Derived views, the registry of queries, and the queries with their DuckDB SQL."""
