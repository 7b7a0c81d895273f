"""Part of the analytics library: functions."""
