"""Keyed collections, search and vectors as DataFrame transforms."""
