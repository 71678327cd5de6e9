"""Text functions as Catalyst expressions: normal form, whitespace, URLs, hashes, phrase containment, escaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points, in lower case, whose full case folding reaches ASCII letters and is not their lower case.
FOLDED = "ſßŉǰẖẗẘẙẚﬀﬁﬂﬃﬄﬅﬆ"
#: Unicode whitespace as a regular-expression class.
WHITESPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
#: The characters of a normal form.
KEPT = frozenset("abcdefghijklmnopqrstuvwxyz0123456789:/+-")
NOT_KEPT = "[^a-z0-9:/+-]+"


def normalize(c: Column) -> Column:
    """Case-folded, with everything but a-z, 0-9, ``: / + -`` as single spaces; null gives ''.

    A chain without branches, so no step is ever computed twice: plain searches for the few characters that lower
    case does not fold, then one regular expression that turns runs of whatever is not kept into a space.
    """
    c = F.lower(F.coalesce(c, F.lit("")))
    for x in FOLDED:
        c = F.replace(c, F.lit(x), F.lit(x.casefold()))
    return F.trim(F.regexp_replace(c, NOT_KEPT, " "))


def normalize_literal(text: str) -> str:
    """``normalize`` for phrases of the configuration, on the driver."""
    return " ".join("".join(x if x in KEPT else " " for x in text.casefold()).split())


def compact(c: Column) -> Column:
    """Runs of Unicode whitespace as one space, trimmed; null gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), WHITESPACE, " "))


URL_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def url_text(c: Column) -> Column:
    """What counts of a URL's text: no line breaks and tabs, other whitespace only inside."""
    return F.translate(F.regexp_replace(F.coalesce(c, F.lit("")), f"^{WHITESPACE}|{WHITESPACE}$", ""), "\t\r\n", "")


def url_parts(url: Column) -> Column:
    """A struct of the scheme and host in lower case, the path and the query."""
    part = lambda k: F.regexp_extract(url, URL_PARTS, k)
    return F.struct(F.lower(part(1)).alias("scheme"), F.lower(part(2)).alias("host"), part(3).alias("path"), part(4).alias("query"))


def canonical_parts(parts: Column) -> Column:
    """The canonical URL of ``url_parts``: no trailing slashes, parameters, utm_ keys or blank values; values decoded."""
    scheme, host, path, query = (parts[c] for c in ("scheme", "host", "path", "query"))
    path = F.when(scheme.isin("", "http", "https", "ftp"), F.regexp_replace(path, r";[^/]*$", "")).otherwise(path)
    path = F.regexp_replace(path, "/+$", "")
    pairs = F.transform(
        F.filter(F.split(query, "&", -1), lambda p: p.contains("=")),
        lambda p: F.struct(decoded(F.substring_index(p, "=", 1)).alias("k"), decoded(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("v")),
    )
    kept = F.filter(pairs, lambda p: (p["v"] != "") & ~p["k"].startswith("utm_"))
    query = F.array_join(F.transform(kept, lambda p: F.concat(p["k"], F.lit("="), p["v"])), "&")
    out = F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), path)
    return F.concat(out, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def canonical_url(c: Column) -> Column:
    """Scheme and host in lower case; no trailing slashes, parameters, fragment, utm_ keys or blank values; values decoded.

    Where several are needed, take the steps as columns, one after the other, so that none is computed twice.
    """
    return canonical_parts(url_parts(url_text(c)))


def decoded(c: Column) -> Column:
    """Percent-decoded, + as a space; text with a malformed escape stays as it is but for +."""
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def stable_hash(c: Column) -> Column:
    """SHA-256 of the UTF-8 text, in hex."""
    return F.sha2(c, 256)


def phrase_hits(text: Column, phrases: Sequence[str], label: str = "") -> Column:
    """The phrases, in their order and after a label, whose normal form is in the normalised text.

    One conditional for each phrase: text stands outside of lambdas, so Spark does not compute it once for each phrase.
    """
    if not phrases:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(text.contains(F.lit(normalize_literal(p))), F.lit(label + p)) for p in phrases]))


def any_hit(text: Column, phrases: Sequence[str]) -> Column:
    """Whether a phrase's normal form is in the normalised text."""
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(F.lit(normalize_literal(p)))
    return out


def html_escape(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def rounded(c: Column) -> Column:
    """round(x, 2) of the exact binary value, half to even; SQL's round takes 2.675 for a tie, which it is not.

    200 x is split into two exact products (Veltkamp), so its distance to the odd number between two hundredths is exact.
    """
    below = F.floor(c * 100).cast("double")
    scaled = c * 134217729.0
    high = scaled - (scaled - c)
    over = (high * 200 - (below * 2 + 1)) + (c - high) * 200
    up = (over > 0) | ((over == 0) & (below % 2 != 0))
    return (below + up.cast("double")) / 100


def two_decimals(c: Column) -> Column:
    """x with two decimals as text, rounded like ``rounded``."""
    return F.format_string("%.2f", rounded(c))


def or_else(*columns: Column) -> Column:
    """The first that is neither null nor ''; if none, the last."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns[:-1]], columns[-1])
