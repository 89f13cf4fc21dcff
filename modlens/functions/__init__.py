"""Column functions over module text: no shuffle, no Python worker."""
