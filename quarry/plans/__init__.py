"""Configurations, whole jobs, and the registered queries."""
