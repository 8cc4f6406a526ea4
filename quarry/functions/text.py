"""Text helpers: surrogate repair (H10), ETA text (H14), prompt render (H12),
report field rules (H13)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


REPLACEMENT = "�"

# JSON escapes of UTF-16 surrogates inside reply text.
_HIGH = r"\\u([dD][89abAB][0-9a-fA-F]{2})"
_LOW = r"\\u([dD][c-fC-F][0-9a-fA-F]{2})"
_ANY = r"\\u[dD][89a-fA-F][0-9a-fA-F]{2}"
_M = "\u0001"


def sanitize_json_escapes(raw) -> Column:
    """Replace unpaired ``\\uD8xx`` / ``\\uDCxx`` escapes in JSON text by U+FFFD.

    Escaped backslashes, read from the left, and valid pairs are set aside behind a mark
    and put back after every other surrogate escape is replaced.  The mark itself is
    set aside first, so any text comes back as it was.
    """
    r = _c(raw)
    s = F.replace(r, F.lit(_M), F.lit(_M + "m"))
    s = F.replace(s, F.lit("\\\\"), F.lit(_M + "b"))
    s = F.regexp_replace(s, _HIGH + _LOW, _M + "p$1" + _M + "p$2")
    s = F.regexp_replace(s, _ANY, REPLACEMENT)
    s = F.replace(s, F.lit(_M + "p"), F.lit("\\u"))
    s = F.replace(s, F.lit(_M + "b"), F.lit("\\\\"))
    s = F.replace(s, F.lit(_M + "m"), F.lit(_M))
    return F.when(F.contains(r, F.lit("\\u")), s).otherwise(r)


def repair_text(value) -> Column:
    """Bytes or text with invalid UTF-8 -> valid text (invalid bytes -> U+FFFD)."""
    return F.make_valid_utf8(_c(value).cast("string"))


def format_eta(seconds) -> Column:
    """Compact ETA: '?', '<1s', 'Ns', 'MmSSs', 'HhMMm', 'DdHHh'."""
    s = _c(seconds)
    si = F.floor(s).cast("bigint")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return (F.when(s.isNull() | (s < 0), F.lit("?"))
            .when(s < 1, F.lit("<1s"))
            .when(si < 60, F.concat(si.cast("string"), F.lit("s")))
            .when(si < 3600, F.concat((si / 60).cast("bigint").cast("string"), F.lit("m"),
                                      two(si % 60), F.lit("s")))
            .when(si < 86400, F.concat((si / 3600).cast("bigint").cast("string"), F.lit("h"),
                                       two((si % 3600 / 60).cast("bigint")), F.lit("m")))
            .otherwise(F.concat((si / 86400).cast("bigint").cast("string"), F.lit("d"),
                                two((si % 86400 / 3600).cast("bigint")), F.lit("h"))))


def render_prompt(template, **values) -> Column:
    """Substitute ``{name}`` placeholders in one pass and unescape ``{{``/``}}``.

    The template is split on placeholders first, so substituted values (file
    content that itself contains ``{findings_json}``) are never re-scanned.
    Unknown placeholders render the template as an error (NULL).
    """
    t = _c(template)
    # tokenise: ``{{`` -> \u0001, ``}}`` -> \u0002, then split on placeholders
    guarded = F.replace(F.replace(t, F.lit("{{"), F.lit("\u0001")), F.lit("}}"), F.lit("\u0002"))
    names = "|".join(values)
    # mark each known placeholder with \u0003name\u0003 so a split keeps it
    marked = F.regexp_replace(guarded, r"\{(" + names + r")\}", "\u0003{$1}\u0003")
    pieces = F.split(marked, "\u0003")
    unescape = lambda p: F.replace(F.replace(p, F.lit("\u0001"), F.lit("{")),
                                   F.lit("\u0002"), F.lit("}"))
    # only the template's own pieces are unescaped: values stay as they are
    out = F.array_join(F.transform(pieces, lambda p: _substitute(p, values, unescape(p))), "")
    holders = [F.lit("{" + n + "}") for n in values]
    bad = F.exists(pieces, lambda p: ~p.isin(*holders) & p.rlike(r"[{}]"))
    return F.when(bad, F.lit(None).cast("string")).otherwise(out)


def _substitute(piece: Column, values: dict, literal: Column) -> Column:
    expr = None
    for name, val in values.items():
        v = _c(val) if not isinstance(val, Column) else val
        cond = piece == F.lit("{" + name + "}")
        expr = F.when(cond, F.coalesce(v.cast("string"), F.lit(""))) if expr is None \
            else expr.when(cond, F.coalesce(v.cast("string"), F.lit("")))
    return expr.otherwise(literal)
