"""Evidence analytics on Spark: corpus audit, leak-free splits, claim matching, evidence synthesis, evaluation."""
