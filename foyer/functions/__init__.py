"""Builders of column expressions."""
