"""Prospective issuance as a stream of sessions."""
