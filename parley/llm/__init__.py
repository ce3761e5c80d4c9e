"""Training-data operators: ten jobs over raw text, pages, conversations and vectors.

Nothing outside this folder imports it; ``queries.py`` holds the registered
queries and their oracle SQL.
"""
