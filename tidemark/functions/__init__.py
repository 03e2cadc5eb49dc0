"""Column functions and array routines."""
