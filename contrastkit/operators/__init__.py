"""Relational and statistical operators; every one takes column names and runs on any table."""
