"""Problem 5: text that passed through a wrong character encoding, found and restored by best-first search.

A state is a text; an operation encodes what it can of it with one single-byte encoding and decodes that as UTF-8 or as
an Arabic single-byte encoding, or resolves character references.  States wait in a queue by plausibility cost (negative
log share of their characters in the whole collection, plus a price for each operation); visited texts are known by
hash and not entered twice; the cheapest reachable text wins.
"""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folioflow.llm.charmodel import char_costs

#: Encodings that a text may have been read with by mistake.
WRONG = ("cp1252", "latin_1", "cp1251", "cp1256", "mac_roman", "cp437", "cp850", "cp866", "cp1250", "koi8_r")
#: Single-byte encodings that a text may really have been in.
RIGHT = ("cp1256", "iso8859_6")

LOST = "�"
#: The price of an operation, in the unit of the plausibility cost.
STEP = 3.0
#: Single-byte text has no inner check as UTF-8 has: a stretch needs so many letters, and most must come out Arabic.
LEAST_LETTERS = 3
#: Operations one after the other, and states, at most: a search that ends at these is reported as not finished.
DEPTH = 4
STATES = 80
#: The cost of a character that the collection lacks.
UNKNOWN = 40.0

_ARABIC = re.compile(r"[ؠ-يٮ-ۓەۺ-ۿ]")
_QUESTION_WORDS = re.compile(r"\?{2,}")
#: What no text of these languages has: lost characters, control characters and box drawing.
BROKEN = re.compile(f"[{LOST}\x80-\x84\x86-\x9f\u2500-\u259f]")
#: Letters and signs that bytes beyond ASCII turn into.
_ODD = re.compile(
    "[\u0080-\u009f\u00a1-\u00aa\u00ac\u00ae\u00af\u00b4-\u00b6\u00b8-\u00ba\u00bc-\u00d6\u00d8-\u00f6\u00f8-\u0233"
    "\u02c6-\u02dd\u0401-\u0491\u2500-\u25a0\ufffd]"
)
#: The same where the first byte turned into an Arabic letter and the second into a sign of any text.  It begins with the
#: sign, as that is rare and searched for fast.
_SIGN = "[\u00ab\u00b0-\u00b3\u00b7\u00bb\u00d7\u2030\u2122]"
_ODD_ARABIC = re.compile(f"{_SIGN}(?<=[\u0621-\u064a\u0671-\u06d3]{_SIGN})(?![\\s\u0600-\u06ff])")
#: The same where both bytes of two letters turned into letters and signs that Arabic text may have (cp1256), or a figure's into two signs (mac_roman).
_SECOND = {name: "[" + "".join(re.escape(bytes((b,)).decode(name)) for b in range(0x80, 0xC0)) + "]" for name in ("cp1256", "mac_roman")}
_TWICE = f"[\u0637-\u063a]{_SECOND['cp1256']}[\u0637-\u063a]{_SECOND['cp1256']}"
_ODD_CP1256, _ODD_MAC = re.compile(_TWICE), re.compile(f"[\u2044\u20ac]{_SECOND['mac_roman']}")


def is_suspect(text: str) -> bool:
    """Whether a text may be garbled: a quick test that few others pass, and all garbled texts but a lone Arabic letter
    read as cp1256."""
    if "??" in text or "&" in text:
        return True
    return not text.isascii() and (
        _ODD.search(text) is not None or _ODD_ARABIC.search(text) is not None or _ODD_CP1256.search(text) is not None or _ODD_MAC.search(text) is not None
    )


@lru_cache(maxsize=None)
def _kinds() -> np.ndarray:
    """Code point -> what the sign is in the tests of ``is_suspect``, a bit each; beyond the basic plane all are as the last."""
    table, plane = np.zeros(0x10001, np.uint8), "".join(map(chr, range(0x10000)))
    for bit, part in enumerate((_ODD.pattern, _SIGN, "[\u2044\u20ac]", "&", r"\?", "[\u0637-\u063a]", _SECOND["cp1256"], "[\u0621-\u064a\u0671-\u06d3]")):
        table[[m.start() for m in re.finditer(part, plane)]] |= 1 << bit
    return table


def suspects(texts: list[str], codes: np.ndarray) -> list[int]:
    """Numbers of the texts that ``is_suspect`` finds; ``codes`` are their ``code_points``.

    Signs are looked up for all texts at once; the test itself is for those only that have a sign or signs of its parts.
    """
    kind = _kinds()[np.minimum(codes, 0x10000)]
    hit = (kind & 0b1101) > 0
    hit[1:] |= (kind[:-1] & kind[1:] & 0b10000) > 0
    hit[1:] |= ((kind[:-1] & 0b10000000) > 0) & ((kind[1:] & 0b10) > 0)
    both = ((kind[:-1] & 0b100000) > 0) & ((kind[1:] & 0b1000000) > 0)
    hit[3:] |= both[:-2] & both[2:]
    sizes = np.array(list(map(len, texts)), np.int64)
    full = np.flatnonzero(sizes)
    near = np.unique(np.searchsorted(np.cumsum(sizes[full] + 1), np.flatnonzero(hit), "right"))
    return [i for i in full[near].tolist() if is_suspect(texts[i])]


#: What every reading as UTF-8 has: two signs beyond ASCII in a row, at most one of them Arabic.  The first is searched for by its second sign.
_AFTER_ARABIC = "\x80-\xaa\xac-\xba\xbc-\xbf\u0152-\u0192\u02c6-\u02dc\u201a-\u201c\u201e-\u203a\u20ac\u2122"
_PAIRS = (
    re.compile("[^\x00-\x7f\u0600-\u06ff\u200c-\u200f]{2}"),
    re.compile(f"[{_AFTER_ARABIC}\u200c-\u200f\u2018-\u201d](?:(?<=[\u0621-\u06d3][{_AFTER_ARABIC}])|(?<=[\u0637-\u063a][\u200c-\u200f\u2018-\u201d]))"),
    _ODD_CP1256,
)
#: Three letters in a row that an Arabic single-byte text could have turned into.
_UPPER_WORD = re.compile("[\u00c0-\u00ff\u0401-\u0491\u0152-\u0178\u0192\u02c6-\u02dd\u2500-\u259f]{3}")


@lru_cache(maxsize=None)
def upper_half(name: str) -> dict[str, int]:
    """Character -> byte of the upper half; bytes that the encoding leaves open stand for themselves."""
    table = {}
    for byte in range(0x80, 0x100):
        try:
            char = bytes((byte,)).decode(name)
        except UnicodeDecodeError:
            char = chr(byte)
        table.setdefault(char, byte)
    return table


@lru_cache(maxsize=None)
def utf8_runs(name: str) -> re.Pattern:
    """Runs of characters whose bytes in encoding ``name`` are well-formed UTF-8 beyond ASCII; a lost byte may end one."""
    table = upper_half(name)
    part = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in table.items() if lo <= b <= hi) + "]"
    tail = part(0x80, 0xBF)
    two, three, four = part(0xC2, 0xDF), part(0xE0, 0xEF), part(0xF0, 0xF4)
    if len(bytes(range(0x80, 0x100)).decode(name, "ignore")) == 128:  # no byte is open, so none can have been lost
        ways = ((two, tail), (three, f"{tail}{{2}}"), (four, f"{tail}{{3}}"))
    else:
        ways = ((two, f"(?:{tail}|{LOST})"), (three, f"(?:{tail}{{2}}|{tail}?{LOST})"), (four, f"(?:{tail}{{3}}|{tail}{{0,2}}{LOST})"))
    # begins with the set of all first signs, as that is searched for fast
    first = "|".join(f"(?<={lead}){rest}" for lead, rest in ways)
    return re.compile(f"{part(0xC2, 0xF4)}(?:{first})(?:{'|'.join(lead + rest for lead, rest in ways)})*")


@lru_cache(maxsize=None)
def upper_runs(name: str) -> re.Pattern:
    """Stretches without ASCII letters in which every character beyond ASCII is in the upper half of ``name``; those of less
    than three characters, so less than ``LEAST_LETTERS`` letters, are left out."""
    own = "".join(re.escape(c) for c in upper_half(name) if c not in "«»")
    return re.compile(f"[{own}][{own}\x00-@\\[-`{{-\x7f«»]+[{own}]")


@lru_cache(maxsize=None)
def lower_table(name: str) -> dict[int, str]:
    """Translation of a wrongly read character to its byte, as a Latin-1 character."""
    return {ord(c): chr(b) for c, b in upper_half(name).items()}


def may_move(text: str) -> bool:
    """Whether a text has what some operation changes."""
    return "&" in text or any(pair.search(text) for pair in _PAIRS)


class _Costs(dict):
    def __missing__(self, char: str) -> float:
        return UNKNOWN


class _Runs(dict):
    """Run -> the same read again with encoding ``name``; kept while there are not too many."""

    def __init__(self, repair: Repair, name: str):
        self.repair, self.name = repair, name

    def __missing__(self, run: str) -> str:
        if len(self) > 10_000:
            self.clear()
        self[run] = new = self.repair.reread(self.name, run)
        return new


class Repair:
    """Best-first search with the character costs of one collection."""

    def __init__(self, costs: dict[str, float]):
        self.costs = _Costs(costs)
        self.runs = {name: _Runs(self, name) for name in WRONG}
        self.finished = True

    def cost(self, text: str) -> float:
        return sum(map(self.costs.__getitem__, text))

    def reread(self, name: str, run: str) -> str:
        """One run read again as UTF-8, if that is cheaper; a lost byte leaves a mark."""
        data = run.translate(lower_table(name)).replace(LOST, "\xff").encode("latin_1", "replace")
        try:
            new = data.decode("utf-8", "replace" if LOST in run else "strict")
        except UnicodeDecodeError:  # surrogates and overlong forms
            new = run
        new = re.sub(f"{LOST}+", LOST, new) if LOST in new else new
        return new if self.cost(new.replace(LOST, "")) + 8 * new.count(LOST) < self.cost(run.replace(LOST, "")) + 8 * run.count(LOST) else run

    def _stretches(self, name: str, text: str) -> list[tuple[int, int, str, int, bytes]]:
        """Stretches of a text that may be Arabic single-byte text: begin, end, text, letters and bytes."""
        found = []
        for m in upper_runs(name).finditer(text):
            letters = sum(map(str.isalpha, stretch := m[0]))
            if letters >= LEAST_LETTERS and len(_ARABIC.findall(stretch)) <= 0.2 * letters:
                found.append((*m.span(), stretch, letters, stretch.translate(lower_table(name)).encode("latin_1", "replace")))
        return found

    def _as_arabic(self, text: str, stretches: list[tuple[int, int, str, int, bytes]], right: str) -> str:
        """A text with its stretches read again as Arabic single-byte text, where that is clearly cheaper."""
        out, at = [], 0
        for begin, end, stretch, letters, data in stretches:
            new = data.decode(right, "replace")
            if len(_ARABIC.findall(new)) >= 0.7 * letters and self.cost(new) + LEAST_LETTERS * STEP < self.cost(stretch):
                out += [text[at:begin], new]
                at = end
        return "".join(out) + text[at:]

    def moves(self, text: str) -> Iterator[tuple[str, str]]:
        """Operations that change the text.  Reading as UTF-8 checks itself: where one explains all suspects no other
        encoding is tried, and where one explains most no single-byte one is."""
        if not may_move(text):
            return
        odd, most = None, False
        for name in WRONG:
            read = self.runs[name]
            if (new := utf8_runs(name).sub(lambda m: read[m[0]], text)) != text:  # noqa: B023
                yield f"{name}>utf_8", new
                if not is_suspect(new):
                    return
                odd = len(_ODD.findall(text)) if odd is None else odd
                most = most or len(_ODD.findall(new)) < 0.5 * odd
        if not most and _UPPER_WORD.search(text):
            for name in WRONG:
                if name != "cp1256" and (stretches := self._stretches(name, text)):
                    for right in RIGHT:
                        if (new := self._as_arabic(text, stretches, right)) != text:
                            yield f"{name}>{right}", new
        if "&" in text and (new := html.unescape(text)) != text:
            yield "unescape", new

    def search(self, text: str) -> tuple[str, list[str]]:
        """The cheapest text that is reached, and the operations that lead to it; a text without suspects ends the search.
        ``finished`` tells of the last search whether nothing was left to try."""
        self.finished = True
        if not may_move(text):
            return text, []
        first = self.cost(text)
        best, best_cost = (text, []), first
        seen, turn = {hash(text)}, 0
        queue: list[tuple[float, int, str, list[str]]] = [(first, 0, text, [])]
        while queue and turn < STATES:
            cost, _, state, path = heapq.heappop(queue)
            if cost < best_cost:
                best, best_cost = (state, path), cost
            if path and not is_suspect(state):
                break
            if len(path) >= DEPTH:
                self.finished &= next(self.moves(state), None) is None
                continue
            for name, new in self.moves(state):
                if (h := hash(new)) in seen:
                    continue
                seen.add(h)
                turn += 1
                price = self.cost(new) + STEP * (len(path) + 1)
                if price < cost:  # an operation must pay for itself
                    heapq.heappush(queue, (price, turn, new, [*path, name]))
        else:
            self.finished &= not queue
        return best

    def judge(self, text: str) -> tuple[str, str, str]:
        """``(status, text, operations)``: clean, restored, partly (some is lost) or lost."""
        new, path = self.search(text)
        gone = BROKEN.search(new) is not None or lost_to_questions(new)
        if not path and not gone:
            return "clean", text, ""
        return "restored" if not gone else "partly" if path else "lost", new, ",".join(path)


def lost_to_questions(text: str) -> bool:
    """Whether words of question marks only stand where text was."""
    return len(_QUESTION_WORDS.findall(text)) >= 3 and len(text) > 0 and text.count("?") >= 8


def mostly_lost(text: str) -> bool:
    """Whether more characters stand for lost ones than there are letters."""
    lost = text.count(LOST) + sum(map(len, _QUESTION_WORDS.findall(text)))
    return lost > 0 and lost > sum(map(str.isalpha, text))


def repair_texts(corpus: DataFrame, costs: dict[str, float] | None = None) -> DataFrame:
    """``ord, status, text, operations, finished``: every record, garbled ones with their text restored.

    ``status`` is clean, restored, partly (restored but for characters marked U+FFFD or question marks), lost (nothing
    could be restored), or null for a null text; a blank text is clean.  ``finished`` is false where the search was cut by ``DEPTH``
    or ``STATES``.  Costs are those of all texts unless given.  One
    row a record comes out, in Arrow batches, without a shuffle; texts without a suspect sign never reach the search.
    """
    if costs is None:
        costs = char_costs(corpus, F.col("text"))
    shared = corpus.sparkSession.sparkContext.broadcast(costs)  # one number a character of the basic plane at most
    source = corpus.select("ord", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repair = Repair(shared.value)
        for batch in batches:
            texts, status, steps, ended = batch.column(1).to_pylist(), [], [], []
            for i, text in enumerate(texts):
                searched = text is not None and is_suspect(text)
                found = (None, None, "") if text is None else repair.judge(text) if searched else ("clean", text, "")
                ended.append(not searched or repair.finished)
                status.append(found[0])
                texts[i] = found[1]
                steps.append(found[2])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(status, pa.string()), pa.array(texts, pa.string()), pa.array(steps, pa.string()), pa.array(ended, pa.bool_())],
                names=["ord", "status", "text", "operations", "finished"],
            )

    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"ord {kind}, status string, text string, operations string, finished boolean")


def garbled_records(corpus: DataFrame, costs: dict[str, float] | None = None) -> DataFrame:
    """``ord`` of each record whose text, or some of it, was decoded wrongly, restorable or not."""
    return repair_texts(corpus, costs).where("status <> 'clean'").select("ord")
