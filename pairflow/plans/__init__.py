"""Plans: nodes, the runner and the query catalogue."""
