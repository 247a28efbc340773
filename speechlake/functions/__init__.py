"""functions of speechlake."""
