"""Operators over document text."""
