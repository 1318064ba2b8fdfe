"""Ledger index jobs and text-corpus operators on Spark."""
