"""Requests, references and index files."""
