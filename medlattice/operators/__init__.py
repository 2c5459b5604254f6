"""Part of medlattice: operators."""
