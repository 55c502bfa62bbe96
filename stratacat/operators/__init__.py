"""DataFrame operators of the catalog."""
