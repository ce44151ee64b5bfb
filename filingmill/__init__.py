"""Filings as tables: report text, statements, analytics and search, as Spark jobs."""
