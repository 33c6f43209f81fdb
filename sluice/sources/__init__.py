"""Input formats and where their rows come from."""
