"""Where raw rows come from and where tables are kept."""
