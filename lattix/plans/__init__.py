"""Graph programs: traversal, counting, influence, reasoning, features, sampling, training."""
