"""End-to-end reports and the daily run, composed from the operators."""
