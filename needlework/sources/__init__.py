"""Corpora from files, tables and memory, and configuration."""
