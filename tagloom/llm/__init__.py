"""Training-data operators: thirteen operators over documents, pages and embeddings.

Nothing outside this subpackage imports it; its queries are in ``queries``.
"""
