"""Spark-first analytics for bank extracts: sources, operators, risk rules, search and case files."""
