"""Training-data pipeline operators. Nothing else in calltide imports this subpackage."""
