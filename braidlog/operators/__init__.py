"""Set-based plans that derive document state from the operation log."""
