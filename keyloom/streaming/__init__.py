"""The same conditions over streams."""
