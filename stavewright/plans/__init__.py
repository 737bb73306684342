"""Queries over whole tables, and the SQL that restates them."""
