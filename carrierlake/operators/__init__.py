"""DataFrame-level operators; every grouping column is an argument, so one job covers all keys."""
