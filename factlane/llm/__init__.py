"""Training-data operators: ten corpus components and their registered queries."""
