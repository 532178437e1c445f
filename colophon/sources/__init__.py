"""Readers and writers of the file formats: word-processing documents, spreadsheets, JSON, JSON lines, CSV."""
