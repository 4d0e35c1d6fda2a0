"""Dataset-step operators."""
