"""Incremental forms of the library's aggregates, an extension: tables that grow are read as streams of files."""
