"""Text parts of an e-mail message kept as one string: headers, nested multipart bodies, transfer encodings, HTML, quotes."""

from __future__ import annotations

import binascii
import html
import re
from typing import NamedTuple

_FIELD = re.compile(r"(?im)^(content-type|content-transfer-encoding|content-disposition)[ \t]*:[ \t]*(.*)$")
_HEADER = re.compile(r"[!-9;-~]+[ \t]*:")
_FOLD = re.compile(r"\n[ \t]+")
_PARAM = re.compile(r';[ \t]*([\w*-]+)[ \t]*=[ \t]*("(?:[^"\\]|\\.)*"|[^;\s]*)')
_NOT64 = re.compile(r"[^A-Za-z0-9+/]+")
_HIDDEN = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(style|script|head|title)\b.*?(?:</\1\s*>|\Z)")
_BLOCK = re.compile(r"(?i)</?(?:p|div|blockquote|pre|small|li|ul|ol|tr|td|th|table|h[1-6]|body|html|hr|section|article|address|dl|dt|dd)\b[^>]*>")
_BREAK = re.compile(r"(?i)<br\b[^>]*>")
_TAG = re.compile(r"<[/!?]?[A-Za-z][^>]*>")
_CITE = re.compile(r"(?i)<(/?)blockquote\b[^>]*>")
_MARK = re.compile(r"[ \t]*(?:>|\|(?=[ \t|>]|$))")
_INTRO = re.compile(r"(?i)(?:wrote|writes|schrieb\b.*|escribi[oó]|a écrit)[ \t]*:?[ \t]*$")
_BELOW = re.compile(r"[ \t]*(?:-{3,}[ \t]*(?:original message|forwarded message|ursprüngliche nachricht|mensaje original)[ \t]*-{3,}|_{32})[ \t]*$", re.I)
_FOOTER = re.compile(r"_{40,}[ \t]*$")
_SIGNATURE = re.compile(r"(?:--|____)[ \t]*$")
_PARAGRAPH = re.compile(r"\n[ \t ]*(?:\n[ \t ]*)+")


class Part(NamedTuple):
    html: bool
    attached: bool
    content: str
    alternative: int  # number of the multipart/alternative it belongs to, 0 for none


def _fields(head: str) -> dict[str, str]:
    return {k.lower(): v for k, v in _FIELD.findall(_FOLD.sub(" ", head))}


def _params(value: str) -> dict[str, str]:
    return {k.lower(): v[1:-1] if v[:1] == '"' else v for k, v in _PARAM.findall(value)}


def _bytes(content: str, charset: str) -> bytes:
    try:
        return content.encode("ascii" if content.isascii() else charset)
    except (UnicodeError, LookupError):
        return content.encode("utf-8", "replace")


def _decoded(content: str, encoding: str, charset: str) -> str:
    if encoding == "base64":
        kept = _NOT64.sub("", content)
        raw = binascii.a2b_base64(kept + "=" * (-len(kept) % 4)) if len(kept) % 4 != 1 else binascii.a2b_base64(kept[:-1])
    elif encoding == "quoted-printable":
        if "=" not in content:
            return content
        raw = binascii.a2b_qp(_bytes(content, charset))
    else:
        return content
    try:
        return raw.decode(charset, "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def _sections(body: str, boundary: str) -> list[str]:
    """What stands between the lines of a boundary; a missing end line ends the last one at the end of the text."""
    mark, body, out, at, begun = f"\n--{boundary}", "\n" + body, [], 0, None
    while (at := body.find(mark, at)) >= 0:
        end = at + len(mark)
        line = body.find("\n", end)
        rest = body[end : line if line >= 0 else len(body)].strip()
        if rest not in ("", "--"):
            at = end
            continue
        if begun is not None:
            out.append(body[begun:at])
        begun = None if rest else (line + 1 if line >= 0 else len(body))
        at = end
    if begun is not None:
        out.append(body[begun:])
    return out


def parts(text: str | None) -> list[Part]:
    """Text parts (plain or HTML) of a message in order, decoded; those of other types are left out."""
    out: list[Part] = []
    if not text:
        return out
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    todo, groups = [(text, True, False, 0)], 0
    while todo:
        entity, top, attached, group = todo.pop()
        if entity.startswith("\n"):
            head, body = "", entity[1:]
        else:
            head, _, body = entity.partition("\n\n")
            if not _HEADER.match(head) and not (top and head.startswith("From ")):
                head, body = "", entity
        fields = _fields(head)
        kind_line = fields.get("content-type", "text/plain")
        kind, given = kind_line.partition(";")[0].strip().lower(), _params(kind_line)
        attached = attached or fields.get("content-disposition", "").strip().lower().startswith("attachment")
        if kind.startswith("multipart/") and given.get("boundary"):
            if kind == "multipart/alternative":
                groups += 1
                group = groups
            todo += [(s, False, attached, group) for s in reversed(_sections(body, given["boundary"]))]
        elif kind == "message/rfc822":
            todo.append((body, True, True, 0))
        elif kind.startswith("text/") or "/" not in kind or kind.startswith("multipart/"):
            content = _decoded(body, fields.get("content-transfer-encoding", "").strip().lower(), given.get("charset") or "utf-8")
            out.append(Part(kind == "text/html", attached, content, group))
    return out


def visible(source: str) -> str:
    """HTML without markup: blocks are set apart by blank lines, a line break is white space."""
    s = _HIDDEN.sub(" ", source)
    s = _TAG.sub("", _BREAK.sub("\n", _BLOCK.sub("\n\n", s)))
    return html.unescape(s) if "&" in s else s


def _uncited(source: str) -> str:
    depth, kept, at = 0, [], 0
    for m in _CITE.finditer(source):
        if m[1]:
            if depth:
                depth -= 1
                if not depth:
                    at = m.end()
        else:
            if not depth:
                kept.append(source[at : m.start()])
            depth += 1
    if not depth:
        kept.append(source[at:])
    return "\n\n".join(kept)


def texts(message: str | None) -> list[str]:
    """Every text part, decoded and freed of markup; quoting marks are left, as they are no word characters."""
    return [visible(p.content) if p.html else p.content for p in parts(message)]


def _own_lines(text: str) -> str:
    """Plain text without quoted lines, the lines that introduce them, signatures, list footers and what follows an original-message line."""
    lines, kept, k = text.split("\n"), [], 0
    while k < len(lines):
        line = lines[k]
        if line[:1] == "-" or line[:1] == "_" or line[:1] == " ":
            if _BELOW.match(line) or _FOOTER.match(line):
                break
            if _SIGNATURE.match(line):
                while k < len(lines) and lines[k].strip():
                    k += 1
                continue
        if _MARK.match(line):
            k += 1
            if kept and kept[-1]:
                if _INTRO.search(kept[-1]):
                    kept.pop()
                elif len(kept) > 1 and kept[-1].strip()[-1:] == ":" and _INTRO.search(f"{kept[-2]} {kept[-1]}"):
                    del kept[-2:]
            if not (kept and not kept[-1]):
                kept.append("")
            continue
        kept.append(line)
        k += 1
    return "\n".join(kept)


def own_paragraphs(message: str | None) -> list[str]:
    """Paragraphs of the sender's own text: no headers, quotes, signatures, list footers or attachments; of alternatives one is taken."""
    out: list[str] = []
    taken: set[int] = set()
    found = [p for p in parts(message) if not p.attached]
    plain = {p.alternative for p in found if not p.html and p.content.strip()}
    for p in found:
        if p.alternative and (p.alternative in taken or (p.html and p.alternative in plain)):
            continue
        taken.add(p.alternative)
        s = visible(_uncited(p.content)) if p.html else p.content
        out += [x for x in _PARAGRAPH.split(_own_lines(s)) if x.strip()]
    return out
