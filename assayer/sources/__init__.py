"""sources of the evaluation pipeline."""
