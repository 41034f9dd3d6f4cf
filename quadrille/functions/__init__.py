"""Column expressions: Hilbert curve, geodesy, tile algebra."""
