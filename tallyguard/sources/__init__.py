"""Readers, the derived test book and sinks."""
