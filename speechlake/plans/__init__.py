"""plans of speechlake."""
