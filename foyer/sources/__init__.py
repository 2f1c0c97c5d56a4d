"""Readers of portal payloads, certificates and dimensions."""
