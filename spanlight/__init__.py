"""Spark jobs over flow and provenance tables: windows, joins, rankings, decisions and audits."""
