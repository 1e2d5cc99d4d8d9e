"""Training-data operators. Nothing else in lodestone imports this subpackage."""
