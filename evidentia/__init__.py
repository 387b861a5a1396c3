"""Evidentia: evidence analytics for text claims, documents and images on Spark.

Every operator takes and returns DataFrames; scalar logic is expressed as
Column expressions so that Catalyst sees one plan from scan to result.
"""
