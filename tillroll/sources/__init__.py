"""Readers, the writer, and views over the driver's tables."""
