"""Structured Streaming: landing zones and message reassembly."""
