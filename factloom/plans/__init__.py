"""plans of the fact-flow engine."""
