"""Column helpers, distributed order statistics and tail probabilities."""
