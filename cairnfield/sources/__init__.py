"""Part of the cairnfield package: sources."""
