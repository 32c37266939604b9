"""Scans, the driver-table adapter and the file sinks."""
