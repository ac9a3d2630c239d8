"""Relational operators over sessions, lines, chunks and evidence."""
