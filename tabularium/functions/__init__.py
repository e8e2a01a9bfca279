"""Part of the tabularium engine."""
