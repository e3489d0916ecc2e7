"""The analyses, one module per kind of report."""
