"""Drop folders: the same conversions over files as they arrive."""
