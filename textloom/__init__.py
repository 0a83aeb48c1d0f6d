"""Preparation of language-model training corpora as DataFrame plans."""
