"""Training-data operators: each module holds one, ``queries`` registers them. Nothing outside imports this package."""
