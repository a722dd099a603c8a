"""operators of the fact-flow engine."""
