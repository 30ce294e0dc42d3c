"""Plan-time builders and the catalogue of queries."""
