"""Accounts-receivable cash application as Spark DataFrame operators."""
