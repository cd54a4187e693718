"""Whole plans: URL rules, the corpus build, registered queries and their SQL."""
