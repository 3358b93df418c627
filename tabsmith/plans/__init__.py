"""Registered plans: each builds a lazy DataFrame from the driver tables, with
the equivalent DuckDB SQL kept next to it as the correctness oracle."""
