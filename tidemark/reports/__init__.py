"""Report pages and the families of queries that they are made of."""
