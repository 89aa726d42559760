"""Detection pipelines, their configuration, and the registered queries."""
