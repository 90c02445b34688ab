"""plans of the evaluation pipeline."""
