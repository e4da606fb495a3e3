"""Part of symweave."""
