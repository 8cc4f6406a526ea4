"""Brute-force helpers and odd rows for the operators' tests."""

import re


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


#: Null and empty texts, white space only, one word, ties, repeated rows, non-ASCII, long.
ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "Ünï CÖDÉ İıſK é"),
    (7, "same text here"), (8, "same text here"), (8, "same text here"), (None, "no id at all"),
    (None, None), (9, "a b c " * 4000), (10, "x" * 50_000), (11, "\x00nul\x00 and \u2028 sep"),
]
