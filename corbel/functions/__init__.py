"""Expressions: safe arithmetic, null handling and bin indexes as Columns."""
