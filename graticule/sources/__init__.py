"""Readers, schema normalisation, content seals and table comparison."""
