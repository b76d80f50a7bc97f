"""streaming of convseries."""
