"""Scalar functions as Column builders: calendar and integer axes, key codecs, names and bounds."""
