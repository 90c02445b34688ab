"""operators of the evaluation pipeline."""
