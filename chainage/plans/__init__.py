"""Registered queries: each binds operators to tables, beside the SQL that checks it."""
