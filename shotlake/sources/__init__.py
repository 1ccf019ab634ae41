"""Frame, clip, vector and request tables from the provided ones; versioned job tables."""
