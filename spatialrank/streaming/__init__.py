"""The progress feed as a stream."""
