"""streaming of the evaluation pipeline."""
