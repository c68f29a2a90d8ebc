"""Reading, writing and making tables."""
