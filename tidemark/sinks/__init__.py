"""Writers and file layout."""
