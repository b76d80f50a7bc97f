"""operators of convseries."""
