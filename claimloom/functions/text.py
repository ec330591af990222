"""Document text: extraction from markup, whitespace, and overlapping token windows.

All of it is built-in expressions, so a document never leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chunk geometry and extraction outcomes.
CHUNK_TOKENS = 512
OVERLAP_TOKENS = 64
OK = "OK"
UNREADABLE = "UNREADABLE_PDF"
EMPTY = "EMPTY_PDF_TEXT"

_SPACE = r"[ \t\n\r\f\x0B]+"
_HIDDEN = (
    r"(?is)<!--.*?-->",
    r"(?is)<script\b.*?</script>",
    r"(?is)<style\b.*?</style>",
)
_TAG = r"<[A-Za-z/!?][^>]*>"
_OPEN_TAG = r"<[A-Za-z/!?]"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def normalize_spaces(text: Column) -> Column:
    """Runs of whitespace become one blank; blank text becomes NULL."""
    return F.nullif(F.trim(F.regexp_replace(text, _SPACE, " ")), F.lit(""))


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _visible(raw: Column) -> Column:
    for pattern in _HIDDEN:
        raw = F.regexp_replace(raw, pattern, " ")
    return F.regexp_replace(raw, _TAG, " ")


def _decoded(text: Column) -> Column:
    for entity, character in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def extract_text(content: Column, is_markup: Column) -> Column:
    """``struct(policy_text, status, error_message)`` for one document.

    Markup loses its comments, scripts, styles and tags. A tag that never closes makes the
    document unreadable, as do bytes that are not UTF-8; nothing visible left makes it empty.
    """
    raw = F.coalesce(content.cast("string"), F.lit(""))

    def from_markup(visible: Column) -> Column:
        broken = F.regexp_like(visible, F.lit(_OPEN_TAG))
        return F.when(broken, _outcome(None, UNREADABLE, "markup ends inside a tag")).otherwise(
            _readable(_decoded(visible))
        )

    return (
        F.when(~F.is_valid_utf8(raw), _outcome(None, UNREADABLE, "content is not UTF-8 text"))
        .when(is_markup, _let(_visible(raw), from_markup))
        .otherwise(_readable(raw))
    )


def _readable(text: Column) -> Column:
    bare = F.regexp_replace(text, rf"^{_SPACE}|{_SPACE}$", "")
    return _let(
        bare, lambda t: F.when(t == "", _outcome(None, EMPTY, None)).otherwise(_outcome(t, OK, None))
    )


def _outcome(text: Column | None, status: str, error: str | None) -> Column:
    return F.struct(
        (F.lit(None).cast("string") if text is None else text).alias("policy_text"),
        F.lit(status).alias("status"),
        F.lit(error).cast("string").alias("error_message"),
    )


def chunks(text: Column, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    """``array<struct(chunk_index, chunk_text, token_count)>`` over the whole text.

    Windows of ``size`` blank-separated tokens start every ``size - overlap`` tokens and stop
    with the first one that reaches the end. No text gives an empty array.
    """
    tokens = F.split(normalize_spaces(text), " ")
    windows = _let(tokens, lambda t: _windows(t, size, max(1, size - overlap)))
    return F.coalesce(windows, F.array().cast(_CHUNKS))


def chunk_count(text: Column, size: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> Column:
    """How many windows :func:`chunks` makes, without making them."""
    tokens = F.size(F.split(normalize_spaces(text), " "))
    return F.when(tokens > 0, _last_index(tokens, size, max(1, size - overlap)) + 1).otherwise(0)


_CHUNKS = "array<struct<chunk_index:int,chunk_text:string,token_count:int>>"


def _last_index(tokens: Column, size: int, step: int) -> Column:
    return F.greatest(F.lit(0), F.ceil((tokens - size) / F.lit(step)).cast("int"))


def _windows(tokens: Column, size: int, step: int) -> Column:
    last = _last_index(F.size(tokens), size, step)

    def window(index: Column) -> Column:
        part = F.slice(tokens, index * step + 1, F.lit(size))
        return F.struct(
            index.cast("int").alias("chunk_index"),
            F.array_join(part, " ").alias("chunk_text"),
            F.size(part).alias("token_count"),
        )

    return F.when(tokens.isNotNull(), F.transform(F.sequence(F.lit(0), last), window))


def chunk_id(path: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws("::", path, index.cast("string")), 256)
