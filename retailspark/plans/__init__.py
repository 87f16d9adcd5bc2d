"""The three analyses, composed from the operators."""
