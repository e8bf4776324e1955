"""DataFrame-in, DataFrame-out operators over the archive tables."""
