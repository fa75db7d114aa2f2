"""Read operators: one DataFrame per query, computed for all teams/users at once."""
