"""Subpackage of tidewater."""
