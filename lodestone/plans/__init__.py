"""Registered queries by area; each module's QUERIES maps a name to a function and its DuckDB SQL."""
