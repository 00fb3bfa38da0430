"""The ready metrics, composed from the operators."""
