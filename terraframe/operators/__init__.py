"""Operators over pixels, tiles, masks and detections."""
