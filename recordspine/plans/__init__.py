"""Registered queries over the driver's tables: the fixture views, the plans and their DuckDB SQL."""
