"""Readers and parsers: file names, best-track text and CSV, ledgers, packed examples; and a Python data source."""
