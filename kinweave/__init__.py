"""Population-network analytics on Spark: groups, budgets, communities, edges, metrics, contagion."""
