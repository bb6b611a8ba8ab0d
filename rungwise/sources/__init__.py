"""Readers and writers for the JSONL exchange files."""
