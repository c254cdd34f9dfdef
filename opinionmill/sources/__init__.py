"""Readers, the opinion store and its ledger."""
