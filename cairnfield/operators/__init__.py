"""Part of the cairnfield package: operators."""
