"""Part of the analytics library: operators."""
