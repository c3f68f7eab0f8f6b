"""Clickstream analytics for shop events, on tables and on streams."""
