"""Where entries come from and are kept."""
