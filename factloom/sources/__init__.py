"""sources of the fact-flow engine."""
