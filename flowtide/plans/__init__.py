"""Rules, reports, review, and the engine that chains the operators."""
