"""Training-data operators: ten large-scale corpus operations, each over whole tables."""
