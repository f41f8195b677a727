"""Slow, plain models of what the operators compute, written from the rules."""

import re

SPACE = " \t\n\r\x0b\x0c"
WORD = re.compile(r"[A-Za-z0-9_]")
HEX = re.compile(r"0[xX][0-9a-fA-F]+")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGITS = re.compile(r"[0-9]+")
QUAD = re.compile(r"([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})")
PORT = re.compile(r":[0-9]+")


def _address(text, at):
    found = QUAD.match(text, at)
    if not found or any(int(octet) > 255 for octet in found.groups()):
        return None
    port = PORT.match(text, found.end())
    end = port.end() if port else found.end()
    return None if end < len(text) and WORD.match(text[end]) else end


def message_template(text):
    """Left to right, one place at a time; what was emitted last decides about addresses."""
    out, at = "", 0
    while at < len(text):
        char = text[at]
        if char in SPACE:
            if out and not out.endswith(" "):
                out += " "
            at += 1
            continue
        close = text.find(char, at + 1) if char in "\"'" else -1
        if close >= 0:
            out, at = out + "<str>", close + 1
        elif hexa := HEX.match(text, at):
            out, at = out + "<hex>", hexa.end()
        elif uuid := UUID.match(text, at):
            out, at = out + "<uuid>", uuid.end()
        elif (not out or not WORD.match(out[-1])) and (end := _address(text, at)):
            out, at = out + "<ip>", end
        elif digits := DIGITS.match(text, at):
            out, at = out + "<n>", digits.end()
        else:
            out, at = out + char, at + 1
    return out.rstrip(" ")


def frame_template(frame):
    text = frame.strip()
    if "+0x" in text or "+0X" in text:
        head, _, tail = text.rpartition("+")
        rest = tail.encode()[2:]
        if all(chr(byte) in "0123456789abcdefABCDEF" + SPACE for byte in rest):
            text = head.strip()
    text = re.sub(r":[0-9]+\Z", "", text).strip()
    return HEX.sub("<hex>", text)


def blocks(text):
    """Stack-trace blocks of a whole text."""
    out, current = [], []
    for raw in text.split("\n"):
        line = raw[:-1] if raw.endswith("\r") else raw
        bare = line.rstrip("\r\n")
        continues = line.startswith(("\t", "    ")) or line.strip().startswith("at ")
        if bare and continues and current:
            current.append(bare)
            continue
        if current:
            out.append("\n".join(current))
        current = [bare] if bare else []
    return out + (["\n".join(current)] if current else [])


def windows(events, width):
    """(signature, time, stream, seq) rows to (row, window start, count) rows."""
    state, out = {}, []
    for row in sorted(events, key=lambda r: (r[1], r[2], r[3])):
        signature, at = row[0], row[1]
        if signature == "":
            out.append((row, None, 1))
            continue
        start, seen = state.get(signature, (None, 0))
        if start is None or at - start >= width:
            start, seen = at, 0
        state[signature] = (start, seen + 1)
        out.append((row, start, seen + 1))
    return sorted(out)
