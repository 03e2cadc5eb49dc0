"""Set-oriented operators over access traces."""
