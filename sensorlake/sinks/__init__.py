"""Writers for tables, points, result files and messages."""
