"""Relational operators over courses, documents, content items, extraction state and runs."""
