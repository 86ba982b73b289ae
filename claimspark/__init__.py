"""claimspark: a PySpark pipeline for preparing, classifying and checking short text claims.

Layout
------
sources/    readers (TSV splits, processed tables, driver tables → claims) and writers
functions/  Column -> Column expressions (text cleaning, tokens, n-grams, ratios)
operators/  DataFrame -> DataFrame steps (prepare, TF-IDF, metrics, errors, evidence, scoring)
plans/      composed jobs (preparation run, model selection, experiment, fact-check batch)
streaming/  Structured Streaming scoring
"""

__version__ = "0.1.0"
