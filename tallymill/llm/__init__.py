"""Operators for corpora that language models are trained on."""
