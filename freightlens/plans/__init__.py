"""Datasets put together from several operators: charts, display tables, reports."""
