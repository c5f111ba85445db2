"""Personal data, also in disguise, with offsets into the text as it is written.

Transducers rewrite a text step by step: look-alike letters and digits become
ASCII, spelled digits become digits, "at" and "dot" disguises become "@" and
".".  Each keeps a piecewise map of offsets, so that what is detected in the
rewritten text is given by the characters it was written with.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillforge.llm import textkit as tk
from quillforge.llm.shared import small_batches

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*")
#: A match can't begin inside a run of digits unless the match before ended there, which no greedy match does.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(n if (n := 2 * int(d)) < 10 else n - 9 for d in digits[-2::-2])) % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[Span]:
    """Leftmost non-overlapping local@domain, found from each @, so that long runs without one cost nothing."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield "email", start, m.end()
            last = m.end()
            at = text.find("@", last)
        else:
            last, at = at + 1, text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """By start, then kind as in KINDS."""
    out = list(emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        out += (("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")))
        out += (("card", *m.span()) for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := _only_digits(m[0])) <= 19 and luhn(d))
        if "+" in text:
            out += (("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_only_digits(m[0])) <= 15)
    return sorted(out, key=_order)


def _order(s: Span) -> tuple[int, int, int]:
    return s[1], KINDS.index(s[0]), s[2]


class Rewritten:
    """A text and the source range of each of its characters, kept for the rewritten pieces only."""

    def __init__(self, text: str):
        self.text = text
        self.at, self.source, self.copied = [0], [0], [True]  # pieces: where each begins here and in the source, and whether it is a copy
        self.edited = False

    def _source(self, i: int, end: bool) -> int:
        """Source offset of the character i, or of the end of the character before i."""
        k = bisect_right(self.at, i - end) - 1
        if self.copied[k]:
            return self.source[k] + i - self.at[k]
        return self.source[k + 1] if end else self.source[k]

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self._source(start, False), self._source(end, True)

    def touched(self, start: int, end: int) -> bool:
        """Whether an edit stands in the range or, as a deletion, inside it: pieces end only at edits."""
        k = bisect_right(self.at, start) - 1
        return not self.copied[k] or bisect_right(self.at, end - 1) - 1 > k

    def apply(self, edits: list[tuple[int, int, str]]) -> Rewritten:
        """edits: (start, end, replacement), in order and apart."""
        if not edits:
            return self
        out = Rewritten("")
        parts: list[str] = []
        out.at, out.source, out.copied, length = [], [], [], 0

        def piece(text: str, source: int, copied: bool) -> None:
            nonlocal length
            out.at.append(length), out.source.append(source), out.copied.append(copied)
            parts.append(text)
            length += len(text)

        def keep(start: int, end: int) -> None:
            while start < end:
                k = bisect_right(self.at, start) - 1
                stop = min(end, self.at[k + 1] if k + 1 < len(self.at) else len(self.text))
                piece(self.text[start:stop], self._source(start, False), self.copied[k])
                start = stop

        last = 0
        for start, end, new in edits:
            keep(last, start)
            if new:
                piece(new, self._source(start, False), False)
            last = end
        keep(last, len(self.text))
        piece("", self._source(len(self.text), True), True)
        out.text, out.edited = "".join(parts), True
        return out


# ---- fixed values: look-alikes of ASCII letters in the Cyrillic and Greek alphabets, in pairs
_ALIKE = dict(
    pair.split("=")
    for pair in "а=a в=b с=c е=e һ=h і=i ј=j к=k м=m о=o р=p ѕ=s т=t у=y х=x ѵ=v ԁ=d ԛ=q ԝ=w А=A В=B С=C Е=E Н=H І=I Ј=J К=K М=M О=O Р=P Ѕ=S Т=T У=Y Х=X "
    "α=a β=b ε=e ι=i κ=k ν=v ο=o ρ=p τ=t υ=u χ=x Α=A Β=B Ε=E Ζ=Z Η=H Ι=I Κ=K Μ=M Ν=N Ο=O Ρ=P Τ=T Υ=Y Χ=X ı=i ɡ=g ℓ=l".split()
)
#: characters that show nothing
_HIDDEN = "­​‌‍⁠﻿"
#: hyphens and full stops that stand for the ASCII ones
_MARKS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "。": ".", "․": ".", "．": ".", " ": " ", " ": " "}
#: spelled digits in English, German, French and Spanish
_SPELLED = {
    "0": "zero null zéro cero oh", "1": "one eins un uno", "2": "two zwei zwo deux dos", "3": "three drei trois tres", "4": "four vier quatre cuatro",
    "5": "five fünf cinq cinco", "6": "six sechs seis", "7": "seven sieben sept siete", "8": "eight acht huit ocho", "9": "nine neun neuf nueve",
}
_AT_WORDS = "at|arroba|arobase|klammeraffe|ät"
_DOT_WORDS = "dot|punkt|point|punto"
# ----


def _ascii_form(c: str) -> str | None:
    """The ASCII character that c stands for: by table, by compatibility form, or as a decimal digit."""
    if c in _HIDDEN:
        return ""
    if c in _ALIKE or c in _MARKS:
        return _ALIKE.get(c) or _MARKS[c]
    if (n := unicodedata.decimal(c, None)) is not None:
        return str(n)
    k = unicodedata.normalize("NFKC", c)
    return k if len(k) == 1 and "!" <= k <= "~" and unicodedata.category(c) in ("Lu", "Ll", "Po", "Ps", "Pe", "Sm", "No", "So", "Pd", "Sk", "Pc") else None


_ODD = re.compile(f"[{_HIDDEN}{''.join(map(re.escape, _MARKS))}ıɡℓͰ-ϿЀ-ԯ٠-٩۰-۹०-९！-～⁰-₟①-⓿\U0001d400-\U0001d7ff]")
_DIGIT_OF = {w: d for d, words in _SPELLED.items() for w in words.split()}
_WORD = "|".join(sorted(_DIGIT_OF, key=len, reverse=True))
_PLUS = r"(?:(?:\bplus\b|\+)[\s-]*+)"
_SPELLED_WORD = re.compile(rf"(?i)\b(?:{_WORD})\b")
#: a spelled digit or a number, and what may stand between two of them
_TOKEN = re.compile(rf"(?i)(?P<plus>{_PLUS})?+(?:\b(?P<word>{_WORD})\b|(?P<number>[0-9]++))")
_BETWEEN = rf"(?:[\s,.()\[\]{{}}<>-]|\b(?:{_DOT_WORDS})\b)*+"
_DIGITS_MIXED = re.compile(rf"(?i){_PLUS}?+(?:\b(?:{_WORD})\b|[0-9]++)(?:{_BETWEEN}{_PLUS}?+(?:\b(?:{_WORD})\b|[0-9]++))++")
#: what is dropped between spelled digits; the end of a sentence; what can be a dot of an address
_JOINT, _STOP, _ANY_DOT = re.compile(r"[\s,.-]{1,3}"), re.compile(r"[,.]\s"), re.compile(rf"(?i)\.|\b(?:{_DOT_WORDS})\b")
#: digits without which nothing is a card or a phone number; digits and dots without which nothing is an address
_LEAST_DIGITS, _LEAST_IP = 10, (4, 3)
_BRACKET_AT = rf"\s{{0,3}}[\(\[\{{<]\s{{0,3}}(?:{_AT_WORDS}|@)\s{{0,3}}[\)\]\}}>]\s{{0,3}}"
_BRACKET_DOT = rf"\s{{0,3}}[\(\[\{{<]\s{{0,3}}(?:{_DOT_WORDS}|\.)\s{{0,3}}[\)\]\}}>]\s{{0,3}}"
_DOT = rf"(?:{_BRACKET_DOT}|\s{{1,3}}(?:{_DOT_WORDS})\s{{1,3}})"
_AT = re.compile(rf"(?i)(?P<b>{_BRACKET_AT})|\s{{1,3}}(?:{_AT_WORDS})\s{{1,3}}|[^\S\r\n]{{0,3}}@[^\S\r\n]{{0,3}}")
_DOT_RE = re.compile(f"(?i){_DOT}")
_DOMAIN_DISGUISED = re.compile(rf"(?i)[a-z0-9-]++(?:(?:\.|{_DOT})[a-z0-9-]++)*(?:\.|{_DOT})[a-z]{{2,}}+(?![a-z0-9-])")
_DOT_BEHIND = re.compile(f"(?i){_DOT}$")
#: characters of the longest _DOT
_DOT_CHARS = 20
_IP_DISGUISED = re.compile(rf"(?i)(?<![0-9.])[0-9]{{1,3}}(?:(?:\.|{_DOT})[0-9]{{1,3}}){{3}}(?![0-9])")
#: one of these is in every text that the third transducer changes
_HINTS = tuple(f"{o}{w}" for w in [*_DOT_WORDS.split("|"), *_AT_WORDS.split("|"), ".", "@"] for o in "([{<") + tuple(f" {w} " for w in _DOT_WORDS.split("|"))
_SPACED = re.compile(rf"(?i)[\(\[\{{<]\s{{1,3}}(?:{_AT_WORDS}|{_DOT_WORDS}|[.@])|\s(?:{_DOT_WORDS})\s|\s@|@\s")


def look_alikes(t: Rewritten) -> Rewritten:
    return t.apply([(m.start(), m.end(), k) for m in _ODD.finditer(t.text) if (k := _ascii_form(m[0])) is not None])


def _segments(text: str) -> Iterator[list[re.Match]]:
    """Tokens that stand together, spelled digits among them, and have the digits and dots that a detector needs."""
    for run in _DIGITS_MIXED.finditer(text):
        if not _SPELLED_WORD.search(text, run.start(), run.end()):
            continue
        segment: list[re.Match] = []
        for m in [*_TOKEN.finditer(text, run.start(), run.end()), None]:
            # a number and a spelled digit in the next sentence or clause are apart
            if segment and (m is None or (m["word"] is None) != (segment[-1]["word"] is None) and _STOP.search(text, segment[-1].end(), m.start())):
                digits = sum(len(x["number"] or "1") for x in segment)
                if any(x["word"] for x in segment) and (digits >= _LEAST_DIGITS or digits >= _LEAST_IP[0] and len(_ANY_DOT.findall(text, segment[0].start(), segment[-1].end())) >= _LEAST_IP[1]):
                    yield segment
                segment = []
            if m is not None:
                segment.append(m)


def spelled_digits(t: Rewritten, segments: list[list[re.Match]], dotted: bool = False) -> Rewritten:
    """What joins spelled digits is dropped, but with `dotted` not a bare full stop; what stands beside a number stays."""
    edits = []
    for segment in segments:
        before = None
        for m in segment:
            start = m.start()
            if m["word"]:
                if before is not None and before["word"] and not m["plus"]:
                    gap = t.text[before.end() : start]
                    if _JOINT.fullmatch(gap) and not (dotted and gap == "."):
                        start = before.end()
                edits.append((start, m.end(), "+" * bool(m["plus"]) + _DIGIT_OF[m["word"].lower()]))
            elif m["plus"]:
                edits.append((start, m.start("number"), "+"))
            before = m
    return t.apply(edits)


def _local_dots(text: str, low: int, end: int) -> list[tuple[int, int]] | None:
    """Disguised dots of the local part that ends at `end`, however long it is, or None if there is no local part."""
    dots, at = [], end
    while True:
        part = at
        while at > low and text[at - 1] in _LOCAL:
            at -= 1
        if at == part:  # nothing before a dot: it isn't one
            return None if part == end else dots[1:]
        from_ = max(low, at - _DOT_CHARS)
        if not (m := _DOT_BEHIND.search(text[from_:at])):
            return dots
        dots.insert(0, (from_ + m.start(), at))
        at = from_ + m.start()


def at_and_dot(t: Rewritten) -> Rewritten:
    """An "at" in brackets and a "@" with spaces need a domain after them that ends in letters; a bare "at" also a disguised dot."""
    text, edits, last = t.text, [], 0
    for m in _AT.finditer(text):
        if m.start() < last or not (d := _DOMAIN_DISGUISED.match(text, m.end())):
            continue
        dots = [(x.start(), x.end(), ".") for x in _DOT_RE.finditer(text, d.start(), d.end())]
        if m["b"] is None and not dots and not ("@" in m[0] and len(m[0]) > 1):
            continue
        if (local := _local_dots(text, last, m.start())) is None:
            continue
        edits += [(a, b, ".") for a, b in local]
        edits += [(m.start(), m.end(), "@"), *dots]
        last = d.end()
    out = t.apply(edits)
    return out.apply([(x.start(), x.end(), ".") for m in _IP_DISGUISED.finditer(out.text) for x in _DOT_RE.finditer(out.text, m.start(), m.end())])


def added_spans(text: str, base: list[Span]) -> list[Span]:
    """What only the rewritten text shows, with spelled digits as they are or as digits; spans inside another of their kind are left out."""
    t = Rewritten(text)
    if not text.isascii() and _ODD.search(text):
        t = look_alikes(t)
    versions = [t]
    if segments := list(_segments(t.text)):
        versions.append(spelled_digits(t, segments))
        if any(t.text[x.end() : y.start()] == "." for s in segments for x, y in pairwise(s)):
            versions.append(spelled_digits(t, segments, dotted=True))
    found = set()
    for v in versions:
        low = v.text.lower()
        if any(h in low for h in _HINTS) or _SPACED.search(low):
            v = at_and_dot(v)
        if v.edited:
            found |= {(kind, *v.span(start, end)) for kind, start, end in base_spans(v.text) if v.touched(start, end)}
    inside = lambda x, y: x[0] == y[0] and y[1] <= x[1] and x[2] <= y[2]
    # of equal starts the longest comes first, so what holds a span is the last one kept of its kind or a base span
    out: dict[str, list[Span]] = {k: [] for k in KINDS}
    for x in sorted(found, key=lambda x: (x[1], -x[2])):
        if not (out[x[0]] and inside(x, out[x[0]][-1])) and not any(inside(x, y) for y in base):
            out[x[0]].append(x)
    return sorted((x for spans in out.values() for x in spans), key=_order)


def find_pii(docs: DataFrame, *, text_col: str = "text", prefix: str = "pii_") -> DataFrame:
    """docs and, named with `prefix`: base and added, arrays of (kind, start, end) in code points, end exclusive, by start and kind,
    and redacted, the text with each run of overlapping spans replaced by the bracketed upper-case kind of its first.

    base has what stands in the text as it is; added has what the transducers bring to light.  A null text has no spans and stays
    null when redacted.  Rows stay as they are; columns that begin with `prefix` are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(*[f"`{c}`" for c in docs.columns if not c.startswith(prefix)])
    kind = "array<struct<kind:string,start:int,end:int>>"
    names = [f"{prefix}base", f"{prefix}added", f"{prefix}redacted"]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), f"`{names[0]}` {kind}", f"`{names[1]}` {kind}", f"`{names[2]}` string"])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                base, added, redacted = [], [], []
                for value in part.column(text_col):
                    text = value.as_py()
                    b = base_spans(text) if text else []
                    a = added_spans(text, b) if text else []
                    base.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in b])
                    added.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in a])
                    redacted.append(redact(text, [*b, *a]) if b or a else text)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(base, arrow), pa.array(added, arrow), pa.array(redacted, pa.string())], names=[*part.schema.names, *names])
            tk.give_back()

    return docs.mapInArrow(run, schema)


def redact(text: str, spans: list[Span]) -> str:
    out, last, runs = [], 0, []
    for kind, start, end in sorted(spans, key=_order):
        if runs and start < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], end)
        else:
            runs.append([kind, start, end])
    for kind, start, end in runs:
        out += [text[last:start], f"[{kind.upper()}]"]
        last = end
    return "".join([*out, text[last:]])


def _joined(spans) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_deobfuscation(spark, sf_dir: str) -> DataFrame:
    """The counts are of all spans, those that the method adds included."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    sort_key = lambda s: F.struct(s["start"].alias("a"), rank(s).alias("b"), s["end"].alias("c"), s["kind"].alias("kind"))
    both = F.transform(F.array_sort(F.transform(F.concat("pii_base", "pii_added"), sort_key)), lambda s: F.struct(s["kind"].alias("kind"), s["a"].alias("start"), s["c"].alias("end")))
    found = found.select("doc_id", "pii_base", both.alias("both"))
    of_kind = lambda k: F.size(F.filter("both", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(of_kind, KINDS), F.sha2(_joined("pii_base").cast("binary"), 256).alias("base_sha256"), _joined("both").alias("spans"))
