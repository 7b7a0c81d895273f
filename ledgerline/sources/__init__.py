"""Part of the analytics library: sources."""
