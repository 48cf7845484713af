"""Spark jobs that turn DNS resolver cache dumps into tables and reports."""
