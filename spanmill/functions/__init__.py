"""Subpackage of spanmill."""
