"""Provenance documents and tables, the store's reads and writes, and derived test provenance."""
