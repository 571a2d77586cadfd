"""Appending streams of samples: growing text files, checked batches, live tables."""
