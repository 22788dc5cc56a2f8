"""Readers and writers for scenes, features and manifests."""
