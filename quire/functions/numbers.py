"""Column logic of numbers, versions, references and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LARGEST = 1 << 40


def version_newer(remote: Column, local: Column) -> Column:
    """Dotted numbers compared part by part, absent parts as 0; junk remotely is never newer, junk locally always older."""
    def parts(v: Column) -> Column:
        return F.transform(F.split(v, r"\."), lambda x: F.when(x.rlike(r"^[+-]?[0-9]+$"), x.try_cast("long")))

    r, v = parts(remote), parts(local)
    size = F.greatest(F.size(r), F.size(v))
    pad = lambda x: F.concat(x, F.array_repeat(F.lit(0).cast("long"), (size - F.size(x)).cast("int")))
    junk = lambda x: F.exists(x, lambda p: p.isNull())
    first = F.filter(F.zip_with(pad(r), pad(v), lambda a, b: a - b), lambda d: d != 0)
    return F.when(remote.isNull() | junk(r), False).when(local.isNull() | junk(v), True).otherwise(F.coalesce(F.get(first, F.lit(0)) > 0, F.lit(False)))


def bounded_int(text: Column, most: int = LARGEST) -> Column:
    """Digits only, at most `most`; null otherwise."""
    value = F.when(text.rlike(r"^[0-9]{1,19}$"), text).try_cast("long")
    return F.when(value <= most, value)


def reference(text: Column) -> Column:
    """'N G R' as (object, generation); null otherwise."""
    pattern = r"^\s*([0-9]+)\s+([0-9]+)\s+R\s*$"
    number, generation = (bounded_int(F.regexp_extract(text, pattern, k)) for k in (1, 2))
    return F.when(number.isNotNull() & generation.isNotNull(), F.struct(number.alias("object"), generation.alias("generation")))


def references(text: Column) -> Column:
    """All references outside strings and comments."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\((?:[^()\\]|\\.)*\)", " "), r"%[^\r\n]*", " ")
    found = F.regexp_extract_all(bare, F.lit(r"(?<![0-9A-Za-z])([0-9]+\s+[0-9]+\s+R)(?![0-9A-Za-z])"), 1)
    return F.filter(F.transform(found, reference), lambda x: x.isNotNull())


def number_text(value: Column) -> Column:
    """Two places; 0.00 for what is no finite number."""
    odd = value.isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    return F.when(odd, "0.00").otherwise(F.format_string("%.2f", value))


def pinned(url: Column, host: str) -> Column:
    """The address if it is https at exactly this host."""
    scheme, name = F.regexp_extract(url, "^([a-z]+)://", 1), F.regexp_extract(url, "^[a-z]+://([^/:?#]*)", 1)
    return F.when((scheme == "https") & (name == host), url)
