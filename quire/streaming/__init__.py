"""Stateful operators over event streams, in batch and streaming form."""
