"""Byte views of text and binary columns, patterns, and sizes for display."""
