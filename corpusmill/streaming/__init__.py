"""Cleaning documents as they arrive."""
