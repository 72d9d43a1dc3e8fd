"""Session settings and whole jobs."""
