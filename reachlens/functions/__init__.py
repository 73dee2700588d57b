"""Column expressions without state: calendar, ratios, text and news fields."""
