"""Whole analyses: from files and history to results."""
