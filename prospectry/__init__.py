"""Prospect discovery and outreach analytics on Spark DataFrames."""

from .rules import DEFAULT_RULES, RuleSet

__all__ = ["DEFAULT_RULES", "RuleSet"]
