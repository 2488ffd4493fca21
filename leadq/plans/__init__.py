"""Whole plans put together from the operators, and their SQL counterparts."""
