"""Column functions: no DataFrame is read or made here."""
