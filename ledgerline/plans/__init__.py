"""Part of the analytics library: plans."""
