"""Text expressions, Column to Column, that keep Python's string semantics where the engine's differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends (``trim`` removes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def title(c: Column) -> Column:
    """Every letter after a non-letter upper case, all others lower (``initcap`` only knows spaces)."""
    parts = F.split(c, r"(?<=\P{L})(?=\p{L})", -1)
    return F.array_join(F.transform(parts, lambda s: F.concat(F.upper(F.substring(s, 1, 1)), F.lower(F.substring(s, 2, 1 << 30)))), "")


def words(c: Column) -> Column:
    """Split at white space without empty strings."""
    return F.filter(F.split(strip(c), r"(?U)\s+", -1), lambda w: w != "")


def normalise_subject(c: Column, limit: int = 120) -> Column:
    """Subject key: reply and forward marks off, white space collapsed, lower case, cut."""
    bare = F.regexp_replace(strip(F.coalesce(c, F.lit(""))), r"(?i)^(?:(?:re|fw|fwd)\s*:\s*)+", "")
    return F.substring(F.lower(F.regexp_replace(strip(bare), r"(?U)\s+", " ")), 1, limit)


def name_key(c: Column) -> Column:
    return F.lower(strip(c))


def entity_key(type_: Column, name: Column) -> Column:
    return F.concat(type_, F.lit("::"), name_key(name))


def claim_key(subject: Column, relation: Column, object_: Column) -> Column:
    return F.concat_ws("|", name_key(subject), relation, name_key(object_))


def fingerprint(source_id: Column, excerpt: Column, length: int = 100) -> Column:
    return F.md5(F.concat(source_id, F.lit("|"), F.substring(excerpt, 1, length)))


def artifact_key(excerpt: Column, length: int = 100) -> Column:
    return strip(F.lower(F.substring(excerpt, 1, length)))


def person_name(address: Column) -> Column:
    """Local part of an address as a name; anything without @ as it is."""
    local = F.replace(F.element_at(F.split(address, "@", -1), 1), F.lit("."), F.lit(" "))
    return F.when(F.contains(address, F.lit("@")), title(local)).otherwise(address)


def find(body: Column, part: Column) -> Column:
    """0-based position of the first occurrence, -1 if there is none."""
    return F.position(part, body) - 1


def find_folded(body: Column, part: Column) -> Column:
    return find(F.lower(body), F.lower(part))


def between(body: Column, start: Column, end: Column) -> Column:
    """Code points start..end of the text, end exclusive."""
    return F.substring(body, (start + 1).cast("int"), (end - start).cast("int"))


def clamped(start: Column, end: Column, body: Column) -> tuple[Column, Column]:
    return F.greatest(F.lit(0), start), F.least(F.length(body), end)


def spans(c: Column, pattern: str) -> Column:
    """array<struct<match,start,end>> of all matches, without a Python worker.

    The text between matches comes from splitting with the same pattern, so positions are running lengths.
    """
    found = F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(c, pattern, -1), F.lit(1), F.greatest(F.size(found), F.lit(0)))
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("hit"))
    kind = "struct<at:int,out:array<struct<match:string,start:int,end:int>>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(kind)

    def step(done: Column, pair: Column) -> Column:
        start = done["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        one = F.struct(pair["hit"].alias("match"), start.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(one)).alias("out"))

    return F.aggregate(pairs, begin, step, lambda done: done["out"])


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """``part`` of ``whole`` as text such as 75.0%; 0 of 0 is 0%."""
    return F.format_string(f"%.{digits}f%%", part * 100.0 / F.greatest(whole, F.lit(1)))
