"""Operators for training data: sampling to target shares, token ids, leaked passages, abusive content."""
