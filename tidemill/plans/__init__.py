"""Registered queries: operators applied to whole tables, each beside its check in SQL."""
