"""Complete jobs assembled from operators, and the registered queries."""
