"""Questions to the case model; each returns a DataFrame."""
