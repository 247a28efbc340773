"""streaming of speechlake."""
