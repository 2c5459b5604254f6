"""Part of medlattice: functions."""
