"""operators of speechlake."""
