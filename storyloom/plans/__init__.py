"""Registered queries and their check texts."""
