"""Catalogue cleaning and corpus jobs as Spark DataFrame operators."""
