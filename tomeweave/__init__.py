"""Spark jobs for bibliographic records: captured tables in, reconciled book tables out."""
