"""streaming of the fact-flow engine."""
