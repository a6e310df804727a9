"""Plans: the engine, publishing, and the catalogue of queries."""
