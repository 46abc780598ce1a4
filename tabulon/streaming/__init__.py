"""The sealed log as a stream."""
