"""Brute-force versions shared by the operators' and the pipeline's tests."""

from test_decontaminate import brute as brute_leaks
from test_secrets import brute as brute_spans
from test_simhash import brute as brute_simhash

__all__ = ["brute_leaks", "brute_simhash", "brute_spans"]
