"""plans of convseries."""
