"""Rules that are read before a plan is built: frequencies and patterns."""
