"""Part of the cairnfield package: streaming."""
