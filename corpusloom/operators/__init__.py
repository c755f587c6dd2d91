"""Operators over corpora, metrics, event logs and evaluations."""
