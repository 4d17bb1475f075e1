"""Salary analytics over job postings, expressed as Spark DataFrame queries."""
