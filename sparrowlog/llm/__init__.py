"""Corpus-preparation operators for training data.

Every operator takes DataFrames and returns DataFrames.  Nothing outside this
package imports it; ``llm.queries`` holds the registered queries and their SQL.
"""
