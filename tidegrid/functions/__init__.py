"""Column builders: calendar, grid, packing and wording. No Python UDFs."""
