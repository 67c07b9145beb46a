"""Operators for preparing language-model training data. Nothing else in slackframe imports this."""
