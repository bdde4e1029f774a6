"""Readers and writers of documents, knowledge bases, annotations and results."""
