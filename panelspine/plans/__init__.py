"""Queries: the operators bound to tables, with equivalent SQL."""
