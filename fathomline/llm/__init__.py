"""Operators for training data: near-copies, personal data, quality, mixing, licences,
benchmark leaks, toxicity, language, vectors and web pages."""
