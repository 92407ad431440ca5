"""Places of elements in the bytes of an XML part, so that texts can be replaced without writing the rest anew."""

from __future__ import annotations

from dataclasses import dataclass, field
from xml.parsers import expat
from xml.sax.saxutils import escape


@dataclass
class Element:
    name: str  # namespace and local name, with a blank between
    attributes: dict[str, str]
    path: tuple[str, ...]  # names of what it stands in, outermost first
    start: int  # offset of the tag, of what follows it, and of the end tag
    inside: int
    close: int = -1
    text: list[str] = field(default_factory=list)  # of the element itself
    whole: list[str] = field(default_factory=list)  # with what its elements have

    @property
    def local(self) -> str:
        return self.name.rpartition(" ")[2]

    @property
    def content(self) -> str:
        return "".join(self.text)

    @property
    def all_content(self) -> str:
        return "".join(self.whole)


def _tag_end(data: bytes, at: int) -> int:
    quote = 0
    while at < len(data):
        c = data[at]
        if quote:
            quote = 0 if c == quote else quote
        elif c in b"\"'":
            quote = c
        elif c == 62:
            return at + 1
        at += 1
    return at


def elements(data: bytes) -> list[Element]:
    """All elements in document order. Raises expat.ExpatError for what is not XML."""
    out: list[Element] = []
    open_: list[Element] = []
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True

    def begin(name: str, attributes: dict[str, str]) -> None:
        at = parser.CurrentByteIndex
        e = Element(name, attributes, tuple(x.name for x in open_), at, _tag_end(data, at))
        out.append(e)
        open_.append(e)

    def end(_: str) -> None:
        e = open_.pop()
        e.close = e.inside if data[e.inside - 2 : e.inside] == b"/>" else parser.CurrentByteIndex

    def text(value: str) -> None:
        if open_:
            open_[-1].text.append(value)
        for e in open_:
            e.whole.append(value)

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = begin, end, text
    parser.Parse(data, True)
    return out


def replaced(data: bytes, texts: list[tuple[Element, str, bool]]) -> bytes:
    """The part with the contents of elements replaced; the last value of each says whether blanks must be declared significant."""
    out, at = [], 0
    for e, value, preserve in sorted(texts, key=lambda x: x[0].start):
        tag, empty = data[e.start : e.inside], e.close == e.inside and data[e.inside - 2 : e.inside] == b"/>"
        name = tag[1:].split(None, 1)[0].rstrip(b"/>")
        tag = tag[:-2].rstrip() + b">" if empty else tag
        if preserve and "http://www.w3.org/XML/1998/namespace space" not in e.attributes:
            tag = tag[:-1] + b' xml:space="preserve">'
        out += [data[at : e.start], tag, escape(value).encode(), b"</" + name + b">" if empty else b""]
        at = e.close
    return b"".join([*out, data[at:]])
