"""Evidence retrieval and claim verification as DataFrame plans."""
