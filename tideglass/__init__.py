"""Analytics for live win probability in 5v5 matches, on Spark."""
