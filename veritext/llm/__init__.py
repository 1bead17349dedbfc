"""Operators for preparing training data, each built by one named method.

warc, packing, ann, token_counts, quality, neardup, html_text, mixing,
lines and fingerprints hold one operator each; pretokens, components and
shared are helpers.  ``queries`` registers one query per operator.
"""
