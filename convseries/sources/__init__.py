"""sources of convseries."""
