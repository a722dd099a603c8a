"""functions of the fact-flow engine."""
