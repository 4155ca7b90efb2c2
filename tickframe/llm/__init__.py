"""Operators for large text corpora: mixing, archives, near duplicates, leaks, scoring, privacy, rendering.

Nothing outside this subpackage imports it. Import the modules that you need; this file stays empty of
code so that Python workers load quickly.
"""
