"""Readers and writers: files, page bodies, scripts, listings, sinks."""
