"""Plan shapes shared by the operators: exact ranks, split ordered groups, checkpoints."""
