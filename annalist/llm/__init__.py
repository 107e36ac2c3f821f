"""Training-data operators. Nothing else in annalist imports this subpackage."""
