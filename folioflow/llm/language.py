"""Problem 2: the language of each record and of each stretch of it, by a linear-chain conditional random field.

Every word of a text has a label.  Its emission scores are sums of learned weights of hashed features (the word itself,
its beginnings and endings, its letter pairs and triples, its script, its entry in a lexicon of the fit); transitions between neighbouring words are learned
too; forward-backward gives each word's label probabilities.  Sentences take the language of most of their letters.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from folioflow.llm.charmodel import char_costs
from folioflow.llm.encoding import LOST, Repair, is_suspect, lost_to_questions, mostly_lost
from folioflow.llm.lookalike import compatible

LANGUAGES = ("ps", "fa", "ar", "en")
#: The field is fitted on about this many labelled records, taken by a hash of their ordinal.
SAMPLE_ROWS = 2500
FEATURES = 1 << 16
#: Features of a word at most: of words of over about 40 letters the last letter groups are left out.
WORD_FEATURES = 80
#: A word is in the lexicon if it occurs so often in the half of the fit sample that the lexicon is made from; it has the
#: languages with these shares of its occurrences.
LEXICON_COUNT, LEXICON_SHARES = 2, (0.95, 0.6, 0.3)
#: The fit ends after so many turns, or when a turn makes the labels of the sample less than this more probable.
TURNS, LEAST_GAIN = 40, 2e-4
MAX_WORDS = 300_000
#: What is shorter goes with the sentence before it (or after, at the beginning).
LEAST_WORDS, LEAST_LETTERS = 2, 6

WORD = re.compile(r"[^\W\d_][\w\u200c\u200dً-ٰٟ]*")
SENTENCE_END = re.compile(r"(?<=[.!?؟۔])[\"'”’»)\]]*\s+")
#: Question marks that stand for a lost word and end no sentence.
_LOST_WORD = re.compile(r"(?<![^\W_])\?{2,}|(?<!\S)\?(?!\S)")


def split_sentences(text: str) -> list[str]:
    """Parts that end with a full stop, question or exclamation mark; line ends alone do not end a sentence."""
    return [s for s in SENTENCE_END.split(text) if s]


def readable_sentences(text: str) -> list[str]:
    """Sentences of a text that a wrong encoding has lost in part, without those that are lost for the most part."""
    if lost_to_questions(text):
        text = _LOST_WORD.sub(lambda m: LOST * len(m.group()), text)
    return [s for s in split_sentences(text) if not mostly_lost(s)]


Lexicon = dict[str, tuple[str, ...]]


def features(word: str, lexicon: Lexicon) -> list[int]:
    """Hashed features of a word in compatible form and lower case (so without joiners)."""
    w = compatible(word).lower() or word
    script = "a" if "\u0600" <= w[0] <= "ۿ" else "l" if w[0] < "԰" else "o"
    parts = [f"s{script}", f"w{w}", *lexicon.get(w, ("x",))]
    for n in (1, 2, 3):
        parts += [f"p{w[:n]}", f"e{w[-n:]}"]
    for n in (2, 3):
        parts += [f"g{w[i : i + n]}" for i in range(len(w) - n + 1)]
    return [zlib.crc32(p.encode("utf-8", "replace")) % FEATURES for p in parts[:WORD_FEATURES]]


def make_lexicon(sentences: list[list[str]], langs: list[int]) -> Lexicon:
    """Word -> its lexicon features: which language has how large a share of its occurrences."""
    counts: dict[str, np.ndarray] = {}
    for words, lang in zip(sentences, langs):
        for word in words:
            w = compatible(word).lower() or word
            if w not in counts:
                counts[w] = np.zeros(len(LANGUAGES))
            counts[w][lang] += 1
    out = {}
    for w, n in counts.items():
        if (total := n.sum()) >= LEXICON_COUNT:
            level = [next((k for k, least in enumerate(LEXICON_SHARES) if x >= least * total), None) for x in n]
            out[w] = tuple(f"l{k}{lang}" for k, lang in zip(level, LANGUAGES) if k is not None)
    return out


class Words(dict):
    """Word -> row of the emission table; made when first seen."""

    def __init__(self, lexicon: Lexicon | None = None):
        super().__init__()
        self.lexicon = lexicon or {}
        self.rows: list[list[int]] = []
        self.letters: list[int] = []

    def __missing__(self, word: str) -> int:
        self[word] = found = len(self.rows)
        self.rows.append(features(word, self.lexicon))
        self.letters.append(sum(map(str.isalpha, word)))
        return found


def padded(sequences: list[np.ndarray], rows: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of sequences of like length: (which, word ids (n, t), lengths); a block has about ``rows`` cells."""
    lengths = np.array([len(s) for s in sequences])
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        n = 1
        while at + n < len(order) and (n + 1) * lengths[order[at + n]] <= rows:
            n += 1
        which = order[at : at + n]
        block = np.zeros((n, lengths[which[-1]]), np.int64)
        for i, k in enumerate(which):
            block[i, : lengths[k]] = sequences[k]
        yield which, block, lengths[which]
        at += n


def forward_backward(scores: np.ndarray, lengths: np.ndarray, start: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Label probabilities (n, t, l); with ``pairs`` also the expected transitions and the log partition of each row."""
    n, t, k = scores.shape
    top = scores.max(2, keepdims=True)
    emit = np.exp(scores - top)
    move = np.exp(trans)
    alpha, scale = np.empty_like(emit), np.ones((n, t))
    a = emit[:, 0] * np.exp(start)
    for i in range(t):
        if i:
            a = (alpha[:, i - 1] @ move) * emit[:, i]
        scale[:, i] = a.sum(1)
        alpha[:, i] = a / scale[:, i : i + 1]
    beta = np.ones((n, k))
    out = np.empty_like(emit)
    moved = np.zeros((k, k))
    inside = np.arange(t)[None] < lengths[:, None]
    for i in range(t - 1, -1, -1):
        out[:, i] = alpha[:, i] * beta
        if i:
            ahead = emit[:, i] * beta / scale[:, i : i + 1]
            if pairs:
                on = inside[:, i]
                moved += move * (alpha[on, i - 1].T @ ahead[on])
            back = ahead @ move.T
            beta = np.where(inside[:, i : i + 1], back, 1.0)
    out /= out.sum(2, keepdims=True)
    if not pairs:
        return out
    logz = ((np.log(scale) + top[:, :, 0]) * inside).sum(1)
    return out, moved, logz, inside


class Field:
    """Weights of the conditional random field."""

    def __init__(self):
        k = len(LANGUAGES)
        self.lexicon: Lexicon = {}
        self.weights = np.zeros((FEATURES, k), np.float64)
        self.trans = np.zeros((k, k))
        self.start = np.zeros(k)

    def emissions(self, words: Words, since: int = 0) -> np.ndarray:
        rows = words.rows[since:]
        if not rows:
            return np.zeros((0, len(LANGUAGES)))
        flat = np.concatenate([np.asarray(r, np.int64) for r in rows])
        at = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])
        return np.add.reduceat(self.weights[flat], at, axis=0)

    def fit(self, words: Words, sequences: list[np.ndarray], labels: list[np.ndarray], rounds: int = TURNS, rate: float = 0.1, decay: float = 1e-4) -> None:
        """Gradient ascent (Adam) on the log likelihood of the label sequences."""
        k = len(LANGUAGES)
        flat = np.concatenate([np.asarray(r, np.int64) for r in words.rows])
        owner = np.repeat(np.arange(len(words.rows)), [len(r) for r in words.rows])
        blocks = []
        for which, block, lengths in padded(sequences):
            gold = np.zeros(block.shape, np.int64)
            for i, s in enumerate(which):
                gold[i, : lengths[i]] = labels[s]
            blocks.append((block, lengths, gold))
        total = sum(int(b[1].sum()) for b in blocks)
        params = [self.weights, self.trans, self.start]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        before = 0.0
        for turn in range(1, rounds + 1):
            table, sure = self.emissions(words), 0.0
            seen, g_trans, g_start = np.zeros_like(table), np.zeros((k, k)), np.zeros(k)
            for block, lengths, gold in blocks:
                prob, moved, _, inside = forward_backward(table[block], lengths, self.start, self.trans, True)
                diff = -prob
                at = (np.arange(len(block))[:, None], np.arange(block.shape[1])[None], gold)
                sure += float(prob[at][inside].sum())
                diff[at] += 1
                for c in range(k):
                    seen[:, c] += np.bincount(block[inside], diff[:, :, c][inside], minlength=len(table))
                g_start += diff[:, 0].sum(0)
                both = inside[:, 1:]
                g_trans += np.bincount(gold[:, :-1][both] * k + gold[:, 1:][both], minlength=k * k).reshape(k, k) - moved
            g_weights = np.stack([np.bincount(flat, seen[owner, c], minlength=FEATURES) for c in range(k)], 1)
            for i, (p, g) in enumerate(zip(params, (g_weights, g_trans, g_start))):
                g = g / total * 100 - decay * p
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.99 * second[i] + 0.01 * g * g
                p += rate * (first[i] / (1 - 0.9**turn)) / (np.sqrt(second[i] / (1 - 0.99**turn)) + 1e-8)
            if turn > 5 and abs(sure / total - before) < LEAST_GAIN:
                break
            before = sure / total

    def probabilities(self, table: np.ndarray, sequences: list[np.ndarray]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros((0, len(LANGUAGES)))] * len(sequences)
        for which, block, lengths in padded(sequences):
            prob = forward_backward(table[block], lengths, self.start, self.trans)
            for i, s in enumerate(which):
                out[s] = prob[i, : lengths[i]]
        return out


def plain_label(label: Column) -> Column:
    """A label trimmed, in lower case, without anything from the first ``-`` or ``_`` on."""
    return F.trim(F.regexp_replace(F.lower(F.trim(label)), "[-_].*$", ""))


def word_scores(words: Words, sentences: list[np.ndarray], labels: np.ndarray, rounds: int = 40, rate: float = 0.3) -> np.ndarray:
    """Log probability of each language for each word by itself (logistic regression on the same features)."""
    k = len(LANGUAGES)
    flat = np.concatenate([np.asarray(r, np.int64) for r in words.rows])
    sizes = np.array([len(r) for r in words.rows])
    owner, at = np.repeat(np.arange(len(sizes)), sizes), np.cumsum(sizes) - sizes
    ids = np.concatenate(sentences)
    gold = np.repeat(labels, [len(s) for s in sentences])
    counts = np.bincount(ids * k + gold, minlength=len(sizes) * k).reshape(-1, k).astype(float)
    weights, move = np.zeros((FEATURES, k)), np.zeros((FEATURES, k))
    for _ in range(rounds):
        scores = np.add.reduceat(weights[flat], at, axis=0)
        prob = np.exp(scores - scores.max(1, keepdims=True))
        prob /= prob.sum(1, keepdims=True)
        diff = (counts - counts.sum(1, keepdims=True) * prob) / np.sqrt(counts.sum(1, keepdims=True) + 1)
        g = np.stack([np.bincount(flat, diff[owner, c], minlength=FEATURES) for c in range(k)], 1)
        move = 0.8 * move + rate * np.sign(g) * np.minimum(np.abs(g), 1) * 0.2
        weights += move
    scores = np.add.reduceat(weights[flat], at, axis=0)
    return scores - np.log(np.exp(scores - scores.max(1, keepdims=True)).sum(1, keepdims=True)) - scores.max(1, keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 5) -> Field:
    """Fit on (text, label) of a sample.  Labels are partly wrong and texts partly mixed.  So words are first scored one by
    one, each sentence takes the language that all its words together speak for, and the field is fitted on sequences of
    such sentences, some of one language and some of several.  The lexicon is made from every other sentence, so that the
    other features are learned from words that it lacks."""
    words, field = Words(), Field()
    found = [[s for s in map(WORD.findall, split_sentences(text)) if s] for text, _ in rows]
    texts = [[np.array([words[w] for w in s], np.int64) for s in own] for own in found]
    sentences = [x for s in texts for x in s]
    if not sentences:
        return field
    langs = np.array([LANGUAGES.index(label) for s, (_, label) in zip(texts, rows) for _ in s])
    for _ in range(2):
        scores = np.maximum(word_scores(words, sentences, langs), -6)
        langs = np.array([scores[x].sum(0).argmax() for x in sentences])
    written = [s for own in found for s in own]
    field.lexicon = make_lexicon(written[::2], langs[::2].tolist())
    words = Words(field.lexicon)
    sentences = [np.array([words[w] for w in s], np.int64) for s in written]
    rng = np.random.default_rng(seed)
    mixed, gold, at = [], [], 0
    order = np.argsort(langs + rng.random(len(langs)) * np.where(rng.random(len(langs)) < 0.3, 8, 0), kind="stable")
    while at < len(order):
        part = order[at : at + int(rng.integers(1, 9))]
        mixed.append(np.concatenate([sentences[i] for i in part]))
        gold.append(np.concatenate([np.full(len(sentences[i]), langs[i]) for i in part]))
        at += len(part)
    field.fit(words, mixed, gold)
    return field


class Labeller:
    """Languages of texts in batches, for one worker."""

    def __init__(self, field: Field, costs: dict[str, float]):
        self.field, self.words = field, Words(field.lexicon)
        self.table = np.zeros((0, len(LANGUAGES)))
        self.repair = Repair(costs)

    def label(self, texts: list[str | None]) -> list[list[tuple[str, float, int, int]]]:
        """For each text: its language, confidence, letters and sentences in all, then the same of each stretch if there
        are several.  A text without a letter has none.  Garbled text is judged as it was before, as far as it can be:
        sentences that are mostly lost are left out, all others count."""
        if len(self.words.rows) > MAX_WORDS:
            self.words, self.table = Words(self.field.lexicon), self.table[:0]
        sequences, sizes = [], []
        for text in texts:
            own, size = [], []
            if text:
                for sentence in readable_sentences(self.repair.judge(text)[1]) if is_suspect(text) else split_sentences(text):
                    found = WORD.findall(sentence)
                    size.append(len(found))
                    own.extend(map(self.words.__getitem__, found))
            sequences.append(np.array(own, np.int64))
            sizes.append(size)
        if len(self.table) < len(self.words.rows):
            self.table = np.concatenate([self.table, self.field.emissions(self.words, len(self.table))])
        probs = self.field.probabilities(self.table, sequences)
        result: list[list] = [[] for _ in texts]
        kept = [i for i, s in enumerate(sequences) if len(s)]
        if not kept:
            return result
        # letters of each language in each sentence of the whole batch
        letters = np.array(self.words.letters, np.float64)[np.concatenate([sequences[i] for i in kept])]
        counts = np.concatenate([np.array([n for n in sizes[i] if n]) for i in kept])
        by = np.add.reduceat(np.concatenate([probs[i] for i in kept]) * letters[:, None], np.cumsum(counts) - counts, axis=0)
        lang, n = by.argmax(1), by.sum(1)
        short = (counts < LEAST_WORDS) | (n < LEAST_LETTERS)
        at = 0
        for i in kept:
            m = sum(1 for x in sizes[i] if x)
            own = lang[at : at + m].tolist()
            whole = np.flatnonzero(~short[at : at + m]).tolist()
            if whole and len(whole) < m:  # a word or two are no sentence of their own
                own = [own[max((w for w in whole if w <= j), default=whole[0])] for j in range(m)]
            result[i] = self._stretches(own, n[at : at + m], by[at : at + m])
            at += m
        return result

    @staticmethod
    def _stretches(lang: list[int], size: np.ndarray, by: np.ndarray) -> list[tuple[str, float, int, int]]:
        total = float(size.sum())
        if len(set(lang)) == 1:
            return [(LANGUAGES[lang[0]], float(by[:, lang[0]].sum()) / max(total, 1e-9), round(total), len(lang))]
        best = int(np.bincount(lang, size, minlength=len(LANGUAGES)).argmax())
        rows = [(LANGUAGES[best], float(by[:, best].sum()) / max(total, 1e-9), round(total), len(lang))]
        starts = [0, *(i for i in range(1, len(lang)) if lang[i] != lang[i - 1])]
        for a, b in zip(starts, [*starts[1:], len(lang)]):
            m = float(size[a:b].sum())
            rows.append((LANGUAGES[lang[a]], float(by[a:b, lang[a]].sum()) / max(m, 1e-9), round(m), b - a))
        return rows


def fit_field(corpus: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Field:
    """Fit on a bounded sample of records whose label is one of the languages: those with the least hashes of their ordinal,
    whatever the partitioning."""
    labelled = corpus.select("ord", "text", plain_label(F.col("metadata.language")).alias("label")).where(F.col("label").isin(*LANGUAGES) & (F.length("text") > 0))
    total = corpus.count()
    share = min(1.0, 2 * sample_rows / max(total, 1))
    order = F.xxhash64("ord", F.lit(23))
    part = labelled.where(F.pmod(order, F.lit(1_000_000)) < F.lit(int(share * 1_000_000) + 1)).withColumn("h", order)
    return train([(r.text, r.label) for r in part.orderBy("h", "ord", "text").limit(sample_rows).select("text", "label").collect()])


def language_segments(corpus: DataFrame, field: Field | None = None, costs: dict[str, float] | None = None) -> DataFrame:
    """``ord, label, seg_no, language, confidence, letters, sentences``: language of records and of their stretches.

    ``seg_no`` 0 is the whole record: the language of most of its letters.  A record with sentences in several languages
    has further rows 1, 2, ...: the longest runs of consecutive sentences in one language, in reading order.  A null,
    blank or letterless text has no row, nor has one of which a wrong encoding has lost every sentence for the most part.
    ``label`` is the record's own label, trimmed and shortened; ``confidence`` is the
    mean probability of the language over the letters.  The text of a record is judged in one piece, in Arrow batches,
    without a shuffle; only the sample for the fit and the character costs come to the driver.
    """
    field = field or fit_field(corpus)
    costs = char_costs(corpus, F.col("text")) if costs is None else costs
    shared = corpus.sparkSession.sparkContext.broadcast((field, costs))
    source = corpus.select("ord", plain_label(F.col("metadata.language")).alias("label"), "text").where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(*shared.value)
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32())
        names = ["ord", "label", "seg_no", "language", "confidence", "letters", "sentences"]
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                batch = whole.slice(at, 2000)
                found = labeller.label(batch.column(2).to_pylist())
                rows = [(o, lab, i, *r) for o, lab, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), found) for i, r in enumerate(own)]
                columns = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return source.mapInArrow(run, "ord int, label string, seg_no int, language string, confidence double, letters int, sentences int")


def wrong_labels_and_segments(corpus: DataFrame, field: Field | None = None, costs: dict[str, float] | None = None) -> DataFrame:
    """``ord, seg_no, language``: row 0 of records whose label is missing, unknown or not their language; all stretches of mixed ones."""
    rows = language_segments(corpus, field, costs)
    return rows.where((F.col("seg_no") > 0) | F.col("label").isNull() | (F.col("label") != F.col("language"))).select("ord", "seg_no", "language")
