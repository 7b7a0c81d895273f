"""Part of the analytics library: streaming."""
