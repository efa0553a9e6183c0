"""Jobs composed of several operators, over all commodities and dates at once."""
