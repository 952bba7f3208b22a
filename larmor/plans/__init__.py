"""Plans: whole reconstructions, and the registered queries with their SQL twins."""
