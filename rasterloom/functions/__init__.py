"""Column expressions: CRS, service URLs, request parameters and number text."""
