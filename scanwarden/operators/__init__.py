"""DataFrame operators over scan events."""
