"""Sinks: text, tables and checked publication."""
