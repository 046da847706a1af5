"""Scalar functions on text and URLs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as a regular expression's class body: Unicode's, and the four separators U+001C to U+001F.
WHITE = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
CITATION = r"(?i)\[(PDF|YouTube|Web)\s*[—–-]\s*([^\]]+?)\]"


def is_blank(c: Column) -> Column:
    """True for null and for text of white space only, in the Unicode sense."""
    return ~F.coalesce(c.rlike(f"[^{WHITE}]"), F.lit(False))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WHITE}]+|[{WHITE}]+$", "")


def words(c: Column) -> Column:
    """Words between white space, none of them empty; null gives none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), f"[{WHITE}]+"), "")


def singular(word: Column) -> Column:
    """A word without a plural's ending: -ies becomes -y (not -eies, -aies), -es -e (not -aes, -ees, -oes), -s goes (not -us, -ss)."""
    return (
        F.when(word.rlike("[^ea]ies$"), F.regexp_replace(word, "ies$", "y"))
        .when(word.rlike("[^aeoi]es$"), F.regexp_replace(word, "es$", "e"))
        .when(word.rlike("[^usi]s$") & ~word.rlike("es$"), F.regexp_replace(word, "s$", ""))
        .otherwise(word)
    )


def page_title(html: Column, url: Column) -> Column:
    """The stripped title element; the URL where there is none. A blank title stays blank."""
    pattern = r"(?is)<title>(.*?)</title>"
    return F.when(html.rlike(pattern), strip(F.regexp_extract(html, pattern, 1))).otherwise(url)


def video_metadata(html: Column, url: Column) -> tuple[Column, Column]:
    """Title and channel from a watch page; the URL and ``Unknown`` where they can't be read."""
    title, channel = F.regexp_extract(html, '"title":"([^"]+)"', 1), F.regexp_extract(html, '"ownerChannelName":"([^"]+)"', 1)
    return F.coalesce(F.nullif(title, F.lit("")), url), F.coalesce(F.nullif(channel, F.lit("")), F.lit("Unknown"))


def net_location(url: Column) -> Column:
    """Authority of a URL with user, port and case kept; empty where there is none."""
    return F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))


def video_id(url: Column) -> Column:
    """Path of a short link, else the first ``v`` of the query; null where there is none."""
    short = F.lower(F.try_parse_url(url, F.lit("HOST"))) == "youtu.be"
    return F.when(short, F.regexp_replace(F.try_parse_url(url, F.lit("PATH")), "^/+", "")).otherwise(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("v"))))


def suffix(filename: Column, default: str = ".bin") -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(filename, r"(\.[^./]+)$", 1), F.lit("")), F.lit(default))


def whole_seconds(c: Column) -> Column:
    """Rounded half to even."""
    return F.bround(c).cast("long")


def citation_label(source_type: Column, filename: Column, page: Column, title: Column, second: Column, url: Column) -> Column:
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return (
        F.when(source_type == "pdf", F.concat(F.lit("[PDF — "), text(filename), F.lit(" p."), text(page), F.lit("]")))
        .when(source_type == "youtube", F.concat(F.lit("[YouTube — "), text(title), F.lit(" @"), text(second), F.lit("s]")))
        .otherwise(F.concat(F.lit("[Web — "), text(url), F.lit("]")))
    )


def citations(c: Column) -> Column:
    """What stands in the citations of an answer, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(CITATION), F.lit(2)), strip)


def citation_kinds(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(CITATION), F.lit(1))


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def contains_ignoring_case(c: Column, part: Column) -> Column:
    return F.contains(F.lower(c), F.lower(part))


def nth_word(c: Column, n: int) -> Column:
    """The n-th word, from 1; null where there are fewer."""
    return F.try_element_at(words(c), F.lit(n))


def without_label(c: Column) -> Column:
    """Text behind the last ``] ``."""
    return F.element_at(F.split(c, r"\] "), -1)


def snippet_words(c: Column) -> Column:
    """Of the first six words those of more than four characters."""
    return F.filter(F.slice(words(without_label(c)), 1, 6), lambda w: F.char_length(w) > 4)


def conversation_title(query: Column) -> Column:
    return F.substring(query, 1, 100)


def source_label(filename: Column, title: Column, url: Column, source_id: Column) -> Column:
    return F.coalesce(filename, title, url, source_id)


def collection_type(name: Column) -> Column:
    return F.replace(name, F.lit("_chunks"), F.lit(""))


def sha256_hex(c: Column) -> Column:
    return F.sha2(c, 256)


def format_ms(ms: Column) -> Column:
    return F.when(ms >= 1000, F.format_string("%.2f s", ms / 1000)).otherwise(F.format_string("%.1f ms", ms.cast("double")))


def format_bytes(n: Column) -> Column:
    d = n.cast("double")
    return F.when(d < 1024, F.format_string("%.1f B", d)).when(d < 1024**2, F.format_string("%.1f KB", d / 1024)).when(d < 1024**3, F.format_string("%.1f MB", d / 1024**2)).otherwise(F.format_string("%.1f GB", d / 1024**3))


def size_label(kb: Column) -> Column:
    return F.when(kb < 1024, F.format_string("%d KB", kb.cast("int"))).otherwise(F.format_string("%d MB", F.floor(kb / 1024).cast("int")))


def iso_timestamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def display_date(c: Column) -> Column:
    """Month, day and minute of an ISO timestamp, or the empty text."""
    return F.coalesce(F.date_format(F.try_to_timestamp(c), "MMM d HH:mm"), F.lit(""))


def content_id(*parts: Column) -> Column:
    """A 36-character identifier that depends on the content only, so that jobs can run again."""
    h = F.sha2(F.concat_ws("\x1f", *[F.coalesce(p.cast("string"), F.lit("\x00")) for p in parts]), 256)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
