"""functions of the evaluation pipeline."""
