"""Whole plans: propose and assign, preflight, analysis, runs, verification, and their reports."""
