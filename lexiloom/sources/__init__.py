"""Readers that give (doc_id, line_no, text) or plain lists, and writers."""
