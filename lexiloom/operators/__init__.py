"""Operators over utterances: (doc_id, line_no, text) in, DataFrames out."""
