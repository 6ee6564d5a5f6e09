"""DataFrame operators over the shared intermediate tables."""
