"""functions of convseries."""
