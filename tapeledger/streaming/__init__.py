"""Job event streams."""
