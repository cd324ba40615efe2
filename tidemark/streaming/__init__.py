"""Streams over fact logs."""
