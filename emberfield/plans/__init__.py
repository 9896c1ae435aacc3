"""Derived test views, the query registry and the matching DuckDB SQL."""
