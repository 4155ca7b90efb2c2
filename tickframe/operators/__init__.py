"""Operators over messages, orders, books, samples and series."""
