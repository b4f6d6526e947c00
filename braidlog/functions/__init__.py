"""Scalar codecs and JSON functions."""
