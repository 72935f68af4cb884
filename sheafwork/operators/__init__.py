"""Relational operators over tables of pages, words, packets, roster entries and decisions."""
