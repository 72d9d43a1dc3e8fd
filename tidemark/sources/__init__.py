"""Record layouts and readers."""
