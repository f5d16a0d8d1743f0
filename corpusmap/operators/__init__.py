"""DataFrame operators: relational, text, vector, cluster and tile jobs."""
