"""Column expressions with the semantics of a JavaScript front end: trimming, lengths, falsy values, encodings."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Default colour of a brand.
TEAL = "#00BFA5"
#: Characters that a URI component keeps, but URL encoding for forms escapes, and the other way round.
URI_KEPT = (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~"))


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, then) -> Column:
    """then(value), with the value computed once however often it is used."""
    return F.get(F.transform(F.array(value), then), 0)


def trim(c: Column | str) -> Column:
    """Strips all Unicode white space and byte-order marks, not blanks only."""
    return F.regexp_replace(col(c), r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def name_key(c: Column | str) -> Column:
    """The key by which names are merged."""
    return trim(F.lower(col(c)))


def length(c: Column | str) -> Column:
    """UTF-16 code units, so characters beyond the basic plane count twice."""
    return (F.octet_length(F.encode(col(c), "UTF-16BE")) / 2).cast("int")


def truthy(c: Column | str) -> Column:
    """NULL for the empty text as well."""
    return F.nullif(col(c), F.lit(""))


def first_truthy(*columns: Column | str) -> Column:
    """The first value that is neither NULL nor empty; the last one as it is."""
    return F.coalesce(*map(truthy, columns[:-1]), col(columns[-1]))


def overlay(present: Column, stored: Column | str, default: str | None) -> Column:
    """A stored value beats the default even if it is NULL; the default holds for absent rows."""
    return F.when(present, col(stored)).otherwise(F.lit(default))


def text_or_empty(c: Column | str) -> Column:
    """As a template prints a value that joins like an empty one."""
    return F.coalesce(col(c).cast("string"), F.lit(""))


def join(array: Column | str, separator: str) -> Column:
    """Array.join: NULL elements are empty, not skipped."""
    return F.array_join(col(array), separator, "")


def uri_component(c: Column | str) -> Column:
    out = F.url_encode(col(c))
    for found, put in URI_KEPT:
        out = F.replace(out, F.lit(found), F.lit(put))
    return out


def _hex_pair(digits: Column, at: int) -> Column:
    """parseInt of two hexadecimal digits: a valid prefix counts, and none is no number."""
    pair = F.substring(digits, at, 2)
    return F.when(pair.rlike("^[0-9a-fA-F]"), F.conv(F.regexp_extract(pair, "^[0-9a-fA-F]+", 0), 16, 10).cast("int"))


def hex_to_rgb(c: Column | str) -> Column:
    digits = F.regexp_replace(col(c), "^([^#]*)#", "$1")  # the first # only
    return F.array(*(_hex_pair(digits, at) for at in (1, 3, 5)))


def contrast_text(rgb: Column | str) -> Column:
    """black on bright colours, else white, by luminance."""
    r, g, b = (F.get(col(rgb), i).cast("double") for i in range(3))
    bright = (r * 0.299 + g * 0.587 + b * 0.114) / 255.0
    return F.when(bright > 0.5, "black").otherwise("white")


def sanitize_each(c: Column | str) -> Column:
    """Every character but ASCII letters and digits is an underscore."""
    return F.regexp_replace(col(c), "[^a-zA-Z0-9]", "_")


def sanitize_runs(c: Column | str) -> Column:
    """Every run of such characters is one underscore."""
    return F.regexp_replace(col(c), "[^a-zA-Z0-9]+", "_")


def sanitize_spaces(c: Column | str) -> Column:
    """Every run of white space is one underscore."""
    return F.regexp_replace(col(c), r"(?U)\s+", "_")


def without_quotes(c: Column | str) -> Column:
    return F.replace(col(c), F.lit('"'), F.lit(""))


def spaced(c: Column | str) -> Column:
    """Underscores as blanks."""
    return F.replace(col(c), F.lit("_"), F.lit(" "))


def extension(c: Column | str) -> Column:
    """What follows the last dot; the whole name without one."""
    return F.element_at(F.split(col(c), "[.]"), -1)


def size_label(size: Column | str) -> Column:
    return F.concat(F.round(col(size) / 1024.0, 0).cast("bigint").cast("string"), F.lit("KB"))


def data_uri(mime: Column | str, content: Column | str) -> Column:
    return F.concat(F.lit("data:"), col(mime), F.lit(";base64,"), F.base64(col(content)))


def decode_text(content: Column | str) -> Column:
    """UTF-8 with U+FFFD for bad bytes, as browsers and servers decode."""
    return F.make_valid_utf8(col(content).cast("string"))


def image_format(mime: Column | str) -> Column:
    """What a picture is embedded as: png by its type, else jpeg."""
    return F.when(F.contains(text_or_empty(mime), F.lit("png")), "png").otherwise("jpeg")


def short_date(ts: Column | str) -> Column:
    return F.date_format(col(ts), "MMM d, yyyy")


def long_date(ts: Column | str) -> Column:
    return F.date_format(col(ts), "MMMM d, yyyy")


def numbered(array: Column | str, first: int = 1, sep: str = ". ") -> Column:
    """'1. a', '2. b', ..."""
    return F.transform(col(array), lambda x, i: F.concat((i + first).cast("string"), F.lit(sep), F.coalesce(x, F.lit(""))))


def json_string(c: Column | str) -> Column:
    """A text as a JSON string with its quotes, hexadecimal digits in lower case; NULL becomes null."""
    listed = F.to_json(F.array(col(c)))
    quoted = F.substring(listed, F.lit(2), F.length(listed) - 2)
    small = quoted
    for digits in ("0B", "0E", "0F", "1A", "1B", "1C", "1D", "1E", "1F"):  # an even number of backslashes before it is text
        small = F.regexp_replace(small, rf"(?<!\\)((?:\\\\)*+)\\u00{digits}", rf"$1\\u00{digits.lower()}")
    return F.when(col(c).rlike(r"[\x0b\x0e\x0f\x1a-\x1f]"), small).otherwise(quoted)


def truncated(c: Column | str, n: int) -> Column:
    """The first n characters."""
    return F.left(col(c), F.lit(n))


def prefix(array: Column | str, n: Column) -> Column:
    """The first n elements, all of a shorter array."""
    return F.slice(col(array), F.lit(1), n)


def toggled(array: Column | str, x: Column) -> Column:
    """Membership of x flipped."""
    return F.when(F.array_contains(col(array), x), F.array_remove(col(array), x)).otherwise(F.array_append(col(array), x))


def without_index(array: Column | str, k: Column) -> Column:
    return F.filter(col(array), lambda _, i: i != k)


def first_like(array: Column | str, pattern: str) -> Column:
    """The first element that the pattern is found in."""
    return F.get(F.filter(col(array), lambda x: x.rlike(pattern)), 0)


def lookup(key: Column | str, table: dict[str, str], default: str) -> Column:
    """A fixed table of a few entries."""
    pairs = F.create_map(*(F.lit(v) for pair in table.items() for v in pair))
    return F.coalesce(F.try_element_at(pairs, col(key)), F.lit(default))
