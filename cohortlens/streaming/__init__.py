"""Scoring streams of new respondents."""
