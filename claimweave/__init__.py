"""Claim reconciliation and text-corpus processing as Spark DataFrame jobs."""
