"""Readers, writers and adapters that give operation logs."""
