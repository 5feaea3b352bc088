"""Training-data operators: tokenisation, deduplication, mixing, packing and formatting at corpus scale.

Nothing outside this folder imports it. Each module holds one operator with its own general interface;
``registry`` holds the thin queries over the standard tables and their SQL.
"""
