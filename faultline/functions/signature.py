"""Error signature: hash of a template freed from run-specific values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from faultline.functions.severity import is_error_level
from faultline.functions.text import or_empty, strip

DEFAULT_MAX_FRAMES = 5

HEX = r"0[xX][0-9a-fA-F]+"
UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
# An address starts after a non-word character or right after a UUID, and ends before one.
ADDRESS = (
    rf"(?=[0-9])(?:(?<![A-Za-z0-9_])|(?<={UUID})){OCTET}(?:\.{OCTET}){{3}}(?![0-9])"
    r"(?::[0-9]++)?+(?![A-Za-z0-9_])"
)
# One alternation, so that the leftmost match wins and earlier kinds go first at one place.
# Replacing kind after kind would give other templates.
TOKEN = rf""""[^"]*"|'[^']*'|{HEX}|{UUID}|{ADDRESS}|[0-9]+"""
SPACES = r"[ \t\n\x0B\f\r]+"

# A program counter offset: the last plus sign when only hex digits and spaces follow the two
# bytes after it.
OFFSET = (
    r"\+(?:[\x00-\x7F&&[^+]]{0,2}|[\u0080-߿])[0-9a-fA-F \t\n\x0B\f\r]*\z"
)
LINE_NUMBER = r":[0-9]+\z"


# Private-use characters that frame a token between the passes of ``normalize_message``.
_OPEN, _CLOSE = "\ue000", "\ue001"
# Kind of a framed token by how it starts.
_KINDS = (
    (r"[\"']", "<str>"),
    (r"0[xX]", "<hex>"),
    (r"[0-9a-fA-F]{8}-", "<uuid>"),
    (r"[0-9]+\.", "<ip>"),
    (r"[0-9]", "<n>"),
)


def _token_class(token: Column) -> Column:
    name = F.lit("<n>")
    for start, kind in reversed(_KINDS[:-1]):
        name = F.when(F.rlike(token, F.lit(rf"\A{start}")), kind).otherwise(name)
    return name


def _classified_by_pieces(message: Column) -> Column:
    """Tokens replaced piece by piece; for messages that hold the framing characters."""
    pieces = F.split(message, TOKEN, -1)
    classes = F.transform(F.regexp_extract_all(message, F.lit(TOKEN), F.lit(0)), _token_class)
    # There is one more piece than tokens; the last one gets nothing appended.
    return F.array_join(
        F.zip_with(pieces, classes, lambda piece, name: F.concat(piece, or_empty(name))), ""
    )


def _classified(message: Column) -> Column:
    """Tokens framed in one pass over the message, then replaced kind by kind."""
    text = F.regexp_replace(message, TOKEN, f"{_OPEN}$0{_CLOSE}")
    for start, kind in _KINDS:
        text = F.regexp_replace(text, f"{_OPEN}{start}[^{_CLOSE}]*+{_CLOSE}", kind)
    return text


def normalize_message(message: Column) -> Column:
    """Quoted text, hex addresses, UUIDs, IP addresses and numbers become place holders."""
    framed = F.contains(message, F.lit(_OPEN)) | F.contains(message, F.lit(_CLOSE))
    plain = F.when(framed, _classified_by_pieces(message)).otherwise(_classified(message))
    return F.trim(F.regexp_replace(plain, SPACES, " "))


def normalize_frame(frame: Column) -> Column:
    """Drop line number and program counter offset, replace hex addresses."""
    bare = strip(frame)
    cut = F.when(
        F.rlike(bare, F.lit(r"\+0[xX]")), strip(F.regexp_replace(bare, OFFSET, ""))
    ).otherwise(bare)
    return F.regexp_replace(strip(F.regexp_replace(cut, LINE_NUMBER, "")), HEX, "<hex>")


def template(
    service: Column, message: Column, frames: Column, max_frames: int = DEFAULT_MAX_FRAMES
) -> Column:
    """Service, message and top frames without their run-specific parts.

    '' when service and message are both empty: there is nothing to identify.
    """
    depth = max_frames if max_frames > 0 else DEFAULT_MAX_FRAMES
    top = F.transform(F.slice(frames, 1, depth), normalize_frame)
    head = F.concat(service, F.lit("|"), normalize_message(message))
    full = F.when(F.size(frames) > 0, F.concat_ws("\n", head, top)).otherwise(head)
    return F.when((service == "") & (message == ""), "").otherwise(full)


def signature(of_template: Column) -> Column:
    """First 16 bytes of the SHA-256 in hex; '' for an empty template."""
    return F.when(of_template == "", "").otherwise(
        F.substring(F.sha2(of_template, 256), 1, 32)
    )


def error_template(
    severity: Column,
    service: Column,
    message: Column,
    frames: Column,
    max_frames: int = DEFAULT_MAX_FRAMES,
) -> Column:
    """Template of error-level rows only; other rows skip the work and get ''."""
    return F.when(
        is_error_level(severity), template(service, message, frames, max_frames)
    ).otherwise("")
