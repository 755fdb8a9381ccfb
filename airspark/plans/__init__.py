"""Jobs and model plans built from the operators."""
