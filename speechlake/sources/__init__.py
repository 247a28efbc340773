"""sources of speechlake."""
