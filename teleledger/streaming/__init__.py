"""Structured Streaming: player samples, program state, view appends, patches to commands."""
