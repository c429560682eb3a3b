"""Readers and writers for the text layouts and the tables kept between jobs."""
