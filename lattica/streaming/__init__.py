"""Streams: sample files into growing tables, and windows over events."""
