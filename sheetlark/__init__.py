"""Bulk auditing of spreadsheet workbooks on Spark."""
