"""Bitmap index, run-length bitmaps, joins and small operators."""
