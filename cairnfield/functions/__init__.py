"""Part of the cairnfield package: functions."""
