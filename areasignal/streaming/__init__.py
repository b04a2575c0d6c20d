"""Resumable streams."""
