"""DuckDB SQL that checks every registered query, written apart from the Spark code."""
