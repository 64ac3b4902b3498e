"""Plan shapes shared by the operators: ordering a whole table, spreading hot keys, JSON documents."""
