"""Column functions: text, URLs, policy, vectors and scores as Catalyst expressions; shell commands and free-form JSON as Arrow functions."""
