"""Problem 1: one form for texts that look the same.

After compatibility normalisation (without raised and lowered figures, which look different) and deletion of ignorable
characters, each run of letters and figures is a lattice: every character stands for all characters of the same look,
and some signs (``DOUBTFUL``) may be themselves or, at a price, a letter they can be taken for.  Viterbi finds the path
with the best character-pair score of the collection, where changing the script within a run costs.  The lattice depends
on looks only, so runs that look the same come out the same; whether a doubtful sign is a letter the scores decide.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folioflow.llm.charmodel import pair_table
from folioflow.session import cut

#: Letters of the same look, the Latin one first (Latin, Cyrillic, Greek, Armenian, Cherokee).
LOOKS = (
    "aа", "cсϲ", "dԁ", "eе", "gɡ", "hһ", "iі", "jјϳ", "oоοօ", "pр", "qԛ", "sѕ", "vѵν", "wԝ", "xх", "yу",
    "AАΑᎪ", "BВΒᏴ", "CСϹᏟ", "DᎠ", "EЕΕᎬ", "GᏀ", "HНΗᎻ", "IІΙ", "JЈᎫ", "KКΚᏦ", "LᏞ", "MМΜᎷ", "NΝ", "OОΟՕ", "PРΡᏢ", "SЅՏᏚ", "TТΤᎢ", "VᏙ", "WԜᎳ", "XХΧ", "YҮΥ", "ZΖᏃ",
)

#: Arabic-script letters and digits of the same look, the Persian one first.
ARABIC_LOOKS = ("یيى", "کك", "هەہ", "۰٠", "۱١", "۲٢", "۳٣", "۷٧", "۸٨", "۹٩")

#: The same as a table to the Persian one.
ARABIC = {c: look[0] for look in ARABIC_LOOKS for c in look[1:]}

#: Signs that may be themselves, or a letter that they can be taken for: the scores of the text around decide.
DOUBTFUL = {"ρ": "p", "α": "a", "γ": "y", "υ": "u", "κ": "k", "ι": "i", "σ": "o", "η": "n", "Ӏ": "Il", "ӏ": "l", "ս": "u", "ո": "n", "հ": "h"}

#: The price of reading a doubtful sign as another letter.
DOUBT = 14.0

#: Signs of the same look, to the plainest one.
SIGNS = {"‐": "-", "‑": "-", "ʼ": "’", "\u2028": "\n", "\u2029": "\n", "\x85": "\n", "\t": " "}

#: The price of changing the script between two letters of a token.
SCRIPT_CHANGE = 8.0

#: Signs whose compatibility form looks different.
_KEEP = frozenset("№℠™℡")


_LETTERS = frozenset("".join((*LOOKS, *DOUBTFUL)))


def _form(char: str) -> str | None:
    """What a single character is written as: letters of the lattice stay as they are."""
    if char in SIGNS:
        return SIGNS[char]
    if char in _LETTERS:
        return char
    kind = unicodedata.category(char)
    if kind == "Zs":
        return " "
    if kind == "Cf":
        return ""
    if "\ufe00" <= char <= "\ufe0f" or char in "\u034f\u115f\u1160\u3164":
        return ""
    form = unicodedata.decomposition(char)
    if form.startswith("<") and char not in _KEEP:
        tag = form[1 : form.index(">")]
        if tag not in ("super", "sub", "fraction", "square", "circle", "vertical", "small"):
            char = unicodedata.normalize("NFKC", char).replace("\u00a0", " ")
    return "".join(ARABIC.get(c, c) for c in unicodedata.normalize("NFD", char))


class _Forms(dict):
    """A translation table that fills itself, so that each character is looked up once a worker."""

    def __missing__(self, cp: int) -> str:
        self[cp] = form = _form(chr(cp))
        return form


_FORMS = _Forms()
_HYPHENATED = re.compile("\u00ad(?=\\s*\n)")


def compatible(text: str) -> str:
    """Compatibility normalisation without loss of what a reader can see; line ends become newlines."""
    if text.isascii():
        return text.replace("\r\n", "\n").replace("\r", "\n").replace("\t", " ")
    if "\u00ad" in text:
        text = _HYPHENATED.sub("-", text)
    return unicodedata.normalize("NFC", text.replace("\r\n", "\n").replace("\r", "\n").translate(_FORMS))


def _script(char: str) -> int:
    """A number for the script; figures belong to any."""
    cp = ord(char)
    if char.isdigit():
        return -1
    return 0 if cp < 0x370 else 1 if cp < 0x400 else 2 if cp < 0x530 else 3 if cp < 0x590 else 4 if cp < 0x1000 else 5


class Lattice(dict):
    """Viterbi over look-alike alternatives, by the pair counts of a collection.

    The dictionary is from words between blanks to their form; it is filled on first sight and emptied when it grows too large.
    """

    LIMIT = 300_000

    def __init__(self, pairs: dict[tuple[str, str], int]):
        super().__init__()
        looks = (*LOOKS, *ARABIC_LOOKS)
        self.first = str.maketrans({c: look[0] for look in looks for c in look[1:]})
        self.options = {c: tuple(look) for look in looks for c in look}
        for sign, letters in DOUBTFUL.items():
            self.options[sign] = (sign, *(x for c in letters for x in self.options.get(c, (c,))))
        known = set(self.options) | {c for p in pairs for c in p if c.isalnum()} | set("".join(map("".join, self.options.values())))
        left: dict[str, int] = {}
        for (a, b), n in pairs.items():
            if a in known and b in known:
                left[a] = left.get(a, 0) + n
        size = len(known) + 1
        total = sum(left.values()) + size
        self.single = {c: -math.log((left.get(c, 0) + 1) / total) for c in known}
        self.rare = math.log(total)
        self.pairs = {(a, b): -math.log((n + 0.5) / (left[a] + 0.5 * size)) for (a, b), n in pairs.items() if a in known and b in known}
        self.left = {a: math.log((n + 0.5 * size) / 0.5) for a, n in left.items()}
        self.unseen = math.log(size)
        self.runs = re.compile(f"[^\\W_]*[{''.join(map(re.escape, self.options))}][^\\W_]*")

    def _step(self, a: str, b: str) -> float:
        cost = self.pairs.get((a, b))
        if cost is None:
            cost = self.left.get(a, self.unseen)
        one, other = _script(a), _script(b)
        return cost + (SCRIPT_CHANGE if one != other and one >= 0 and other >= 0 else 0.0)

    def best(self, run: str) -> str:
        """The best spelling of a run; of equal ones the one with the earlier alternatives."""
        paths, before = [(0.0, "")], ""
        for char in run:
            options = self.options.get(char, (char,))
            ways = []
            for i, c in enumerate(options):
                own = DOUBT if i and char in DOUBTFUL else 0.0
                if not before:
                    ways.append((self.single.get(c, self.rare) + own, c))
                else:
                    cost, text = min(((cost + self._step(text[-1], c), text) for cost, text in paths), key=lambda p: p[0])
                    ways.append((cost + own, text + c))
            paths, before = ways, char
        return min(paths, key=lambda p: p[0])[1]

    def __missing__(self, word: str) -> str:
        # every character becomes the first of its look before the search, so that equal looks are equal lattices
        form = self.runs.sub(lambda m: self.best(m.group().translate(self.first)), compatible(word))
        if len(self) > self.LIMIT:
            self.clear()
        if len(word) <= 64:
            self[word] = form
        return form

    def canonical(self, text: str) -> str:
        """Words are looked up one by one: no run has a blank in it, and a mark after a blank stays a mark by itself."""
        if "\u00ad" in text:
            text = _HYPHENATED.sub("-", text)
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        return "\n".join([" ".join(map(self.__getitem__, line.split(" "))) for line in text.split("\n")])


def one_form(df: DataFrame, keep: list[str], text: str, pairs: dict[tuple[str, str], int], name: str = "text") -> DataFrame:
    """``keep`` and the canonical form of ``text`` as ``name``; null stays null, empty stays empty.  No shuffle."""
    shared = df.sparkSession.sparkContext.broadcast(pairs)  # of a size bounded by the alphabet
    source = df.select(*keep, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema[:-1]) + f", `{name}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        for batch in batches:
            texts = [None if v is None else lattice.canonical(v) for v in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, name])

    return source.mapInArrow(run, schema)


def _digests(df: DataFrame, table: str, source: Column, text: Column, pairs: dict) -> DataFrame:
    """``table_name, ord, look, raw`` of rows with a source and a non-blank text: digests of what is seen and of what is written."""
    shared = df.sparkSession.sparkContext.broadcast(pairs)
    rows = df.select("ord", source.alias("s"), text.alias("t")).where("s is not null and t is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        for batch in batches:
            ords, looks, raws = [], [], []
            for o, s, t in zip(*(c.to_pylist() for c in batch.columns)):
                seen = lattice.canonical(t)
                if not seen.strip():
                    continue
                ords.append(o)
                looks.append(hashlib.blake2b(f"{table}\0{s}\0{seen}".encode("utf-8", "replace"), digest_size=16).digest())
                raws.append(hashlib.blake2b(t.encode("utf-8", "replace"), digest_size=8).digest())
            yield pa.RecordBatch.from_arrays([pa.array(ords, pa.int32()), pa.array(looks, pa.binary()), pa.array(raws, pa.binary())], names=["ord", "look", "raw"])

    return rows.mapInArrow(run, "ord int, look binary, raw binary").withColumn("table_name", F.lit(table))


def collection_pairs(corpus: DataFrame, toc: DataFrame) -> dict[tuple[str, str], int]:
    """Counts over all texts and titles of the pairs with a character of the lattice in them: so many at most, whatever the input."""
    both = corpus.select(F.col("text").alias("t")).unionByName(toc.select(F.col("chapter_title").alias("t")))
    return pair_table(both, F.col("t"), {*"".join((*LOOKS, *ARABIC_LOOKS, *DOUBTFUL, *DOUBTFUL.values()))})


def _rows(corpus: DataFrame, toc: DataFrame, pairs: dict) -> DataFrame:
    rows = _digests(corpus, "corpus", F.col("metadata.source_id"), F.col("text"), pairs)
    return rows.unionByName(_digests(toc, "toc", F.col("source_id"), F.col("chapter_title"), pairs))


def same_look_groups(corpus: DataFrame, toc: DataFrame) -> DataFrame:
    """``table_name, ord, look, spelling``: rows with a source and a text, by what is seen and how it is written.

    Rows of equal ``look`` (hexadecimal digest of table, source and look) read the same; ``spelling`` is the least ``ord``
    of the rows that are written in the very same way.  This names every class without a pair of copies; it takes one
    grouping by (look, spelling) that is summed map side, and a join back to it.
    """
    rows = cut(_rows(corpus, toc, collection_pairs(corpus, toc)))
    least = rows.groupBy("look", "raw").agg(F.min("ord").alias("spelling"))
    return rows.join(least, ["look", "raw"]).select("table_name", "ord", F.lower(F.hex("look")).alias("look"), "spelling")


def same_look_pairs(corpus: DataFrame, toc: DataFrame, pairs: dict[tuple[str, str], int] | None = None) -> DataFrame:
    """``table_name, ord_a, ord_b``: two rows of a table and source, written differently but read the same.

    Null sources and null or blank texts are no case; rows with the very same text make no pair with each other.  Rows
    meet by a digest of source and look, so only equal looks are joined; within a look the distinct spellings are paired
    first and the rows come in by spelling, so that many copies of one spelling cost nothing unless they are cases.
    ``same_look_groups`` has the same classes without expanding them to pairs.
    """
    pairs = collection_pairs(corpus, toc) if pairs is None else pairs
    rows = cut(_rows(corpus, toc, pairs))  # some bytes a row, used three times below
    spellings = rows.select("look", "raw").distinct()
    several = spellings.groupBy("look").agg(F.count("*").alias("n")).where("n > 1").select("look")
    spellings = spellings.join(several, "look", "left_semi")
    a, b = spellings.withColumnRenamed("raw", "raw_a"), spellings.withColumnRenamed("raw", "raw_b")
    matched = a.join(b, "look").where("raw_a < raw_b")
    one = rows.select("look", F.col("raw").alias("raw_a"), "table_name", F.col("ord").alias("o1"))
    other = rows.select("look", F.col("raw").alias("raw_b"), F.col("ord").alias("o2"))
    found = matched.join(one, ["look", "raw_a"]).join(other, ["look", "raw_b"])
    return found.select("table_name", F.least("o1", "o2").alias("ord_a"), F.greatest("o1", "o2").alias("ord_b"))


def canonical_texts(corpus: DataFrame, toc: DataFrame) -> DataFrame:
    """``table_name, ord, text``: every text of corpus and every chapter title of toc in its one form."""
    pairs = collection_pairs(corpus, toc)
    texts = one_form(corpus, ["ord"], "text", pairs).withColumn("table_name", F.lit("corpus"))
    titles = one_form(toc, ["ord"], "chapter_title", pairs).withColumn("table_name", F.lit("toc"))
    return texts.unionByName(titles).select("table_name", "ord", "text")
