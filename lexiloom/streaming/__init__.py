"""Stateful operators over streams of utterances."""
