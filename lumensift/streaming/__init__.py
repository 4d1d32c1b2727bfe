"""Learning from a stream of queries."""
