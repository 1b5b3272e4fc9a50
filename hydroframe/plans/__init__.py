"""Registered queries and session plumbing."""
