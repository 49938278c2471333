"""Whole plans: the ledger run, the test relation, the queries."""
