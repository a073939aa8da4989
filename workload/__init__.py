"""Registered queries over the supplied tables, each with the SQL that must agree."""
