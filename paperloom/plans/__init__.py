"""Queries over the driver tables: input views, the Spark side and its SQL counterpart."""
