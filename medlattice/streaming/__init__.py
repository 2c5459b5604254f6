"""Part of medlattice: streaming."""
