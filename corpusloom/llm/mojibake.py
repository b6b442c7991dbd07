"""Text that went through a wrong character decoding: found and restored.

Every wrong decoding is read as a substitution cipher: what stands in the text are symbols (characters, or short runs of them for
multi-byte encodings) in place of letters. Which symbol means which letter is learned per source by expectation-maximization: letter
bigrams of the corpus say how well a reading of a word fits, the mapping so far says how common it is that a symbol means a
letter there, and the readings' weights give the next mapping and take garbled words out of the bigrams.

The first bigrams are those of words that only hold letters of the language of their document, so no decoding, however common, passes
for correct because it is common. Two kinds of ciphers are then learned. Where a known pair of code pages reads a word well, EM starts from
the mapping of that pair and learns its share and its symbols per source. Words that no known pair reads get a free mapping per source
and language: every letter may stand for every symbol at first, and forward-backward passes over the words settle it.

Passes over the texts: bigrams, non-ASCII words with their counts, and the final reading; all rounds of EM read the words only. Models are
small tables: bigrams over a fixed character range, and per source weights of pages and of symbols. The readings are applied with
str.translate().
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import cut, let_workers_import

# fixed values: code pages that texts are wrongly read with, and single-byte pages they were written in
LATIN = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "iso8859_2", "cp852")
CYRILLIC = ("cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic")
PAGES = LATIN + CYRILLIC
ROUNDS = 3  # of expectation-maximization over readings by pages
FOUND = 1.0  # log odds from which a document counts as garbled
START, FLOOR = 1e-3, 1e-5  # share of words that a page pair is believed to have garbled at first, and at least
RUN = 20  # garbled words of a garbled document, by which a share of words is a share of documents
CHANCE = 2.0  # characters of the upper half form a UTF-8 sequence by chance about one time in eight
_OTHER = 3000
_SPLIT = re.compile(r"[ \t\n\r\f\v]+")
_BLANK = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")  # what str.split() takes for white space beside that
_ANY_LETTER = re.compile(r"[^\W\d_]")


# -- characters as numbers -----------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _ids() -> np.ndarray:
    """Number of each character: Latin, combining, Greek and Cyrillic, punctuation and box drawing have their own, others share."""
    ids = np.full(0x110000, _OTHER, np.int32)
    ids[:0x530] = np.arange(0x530)
    ids[0x2000:0x2600] = np.arange(0x530, 0x530 + 0x600)
    ids[0xFB00:0xFB07] = np.arange(2864, 2871)
    ids[0xF8FF], ids[0xFFFD] = 2871, 2872
    ids[[9, 10, 11, 12, 13]] = 32
    return ids


def encode(text: str) -> np.ndarray:
    return _ids()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]


_WIDTH = _OTHER + 1


def bigrams(texts: DataFrame) -> DataFrame:
    """(source, key, n) over all texts: key is first * _WIDTH + second, each text between two blanks; source is null.

    Rows with a source have its number of words, under the key -1.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, words = None, Counter()
        for pdf in batches:
            pdf = pdf.dropna(subset=["text"])
            docs, k = pdf["text"].tolist(), 0
            for source, text in zip(pdf["source"], docs):
                words[source] += len(text.split())
            while k < len(docs):
                size, start = 0, k
                while k < len(docs) and size < 4_000_000:
                    size += len(docs[k]) + 1
                    k += 1
                x = encode(" " + " ".join(docs[start:k]) + " ").astype(np.int64)
                n = np.bincount(x[:-1] * _WIDTH + x[1:], minlength=_WIDTH * _WIDTH)
                at = np.flatnonzero(n)
                part = pd.Series(n[at], index=at)
                total = part if total is None else total.add(part, fill_value=0)
        if total is not None:
            yield pd.DataFrame({"source": None, "key": total.index.astype("int64"), "n": total.to_numpy().astype("int64")})
        yield pd.DataFrame([(s, -1, n) for s, n in words.items()], columns=["source", "key", "n"])

    return texts.select("source", "text").mapInPandas(run, "source string, key long, n long").groupBy("source", "key").agg(F.sum("n").alias("n"))


class Letters:
    """Smoothed bigram log probabilities; absent pairs fall back to the second character's own frequency."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        first = np.bincount(keys // _WIDTH, counts, _WIDTH)
        alone = np.bincount(keys % _WIDTH, counts, _WIDTH) + 0.02
        self.alone = np.log(alone / alone.sum()).astype(np.float32)
        self.back = np.log(0.5 / (first + 0.5)).astype(np.float32)
        order = np.argsort(keys)
        self.keys = keys[order]
        p = (np.maximum(counts[order], 0) + 0.5 * np.exp(self.alone[self.keys % _WIDTH])) / (first[self.keys // _WIDTH] + 0.5)
        self.logs = np.log(p).astype(np.float32)

    def each(self, key: np.ndarray) -> np.ndarray:
        """Log probability of every bigram."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.logs[at], self.back[key // _WIDTH] + self.alone[key % _WIDTH])

    def scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word between blanks."""
        if not words:
            return np.zeros(0)
        key, starts, ends = _pairs(words)
        total = np.concatenate([[0.0], np.cumsum(self.each(key), dtype=np.float64)])
        return total[ends] - total[starts]

    def plausible(self, readings: dict[str, list[Reading]], least: float) -> dict[str, list[Reading]]:
        """The readings all of whose bigrams have at least this log probability, and those of UTF-8, which chance hardly forms; only words that have some."""
        flat = [(w, name, r) for w, options in readings.items() for name, r in options]
        out: dict = {}
        if flat:
            key, starts, _ = _pairs([r for _, _, r in flat])
            for (w, name, r), worst in zip(flat, np.minimum.reduceat(self.each(key), starts)):
                if worst >= least or "<utf8" in name[0]:
                    out.setdefault(w, []).append((name, r))
        return out


def _pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigrams of the words, each between two blanks, and where those of each word begin and end."""
    x = encode(" " + " ".join(words) + " ").astype(np.int64)
    ends = np.cumsum([len(w) + 1 for w in words])
    return x[:-1] * _WIDTH + x[1:], np.concatenate([[0], ends[:-1]]), ends


def _add_bigrams(words: list[str], ns: list[float], sums: dict[int, float]) -> None:
    """Adds the uses of all bigrams of the words, each between two blanks, to the sums."""
    if words:
        key, _, _ = _pairs(words)
        uniq, inverse = np.unique(key, return_inverse=True)
        for k, v in zip(uniq.tolist(), np.bincount(inverse, np.repeat(np.array(ns, float), [len(w) + 1 for w in words])).tolist()):
            sums[k] += v


# -- readings of a word --------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=1)
def _upper_half() -> dict[str, dict[int, str]]:
    """Page -> character of each byte from 0x80; a byte without one stands for the control character of its number."""
    out = {}
    for page in PAGES:
        chars = {}
        for b in range(0x80, 0x100):
            try:
                chars[b] = bytes([b]).decode(page)
            except UnicodeDecodeError:
                chars[b] = chr(b)
        out[page] = chars
    return out


@lru_cache(maxsize=1)
def swaps() -> dict[str, dict[int, str]]:
    """'read<written' -> translate() table, for each two single-byte pages that differ."""
    out = {}
    for read, r in _upper_half().items():
        for written, w in _upper_half().items():
            table = {ord(r[b]): w[b] for b in r if r[b] != w[b] and w[b].isalpha() or (r[b] != w[b] and b >= 0x80 and w[b] in "“”‘’–—…•€™°±µ×·«»¿¡§")}
            if read != written and table:
                out[f"{read}<{written}"] = table
    return out


@lru_cache(maxsize=1)
def _utf8() -> dict[str, tuple[re.Pattern, dict[str, int]]]:
    """Page -> (pattern of UTF-8 sequences as they look when read with it, character -> byte)."""
    out = {}
    for page, chars in _upper_half().items():
        byte = {c: b for b, c in chars.items()}
        if page == "cp1252":  # control characters stand for themselves, as in Latin-1
            byte |= {chr(b): b for b in range(0x80, 0xA0) if chr(b) not in byte}
        cls = lambda lo, hi: "[" + "".join(re.escape(c) for c, b in byte.items() if lo <= b <= hi) + "]"  # noqa: E731, B023
        c = cls(0x80, 0xBF)
        out[page] = re.compile(f"{cls(0xC2, 0xDF)}{c}|{cls(0xE0, 0xEF)}{c}{c}|{cls(0xF0, 0xF4)}{c}{c}{c}"), byte
    return out


class _Decoded(dict):
    """UTF-8 sequence as it looks when read with a page -> its character, or the sequence where it is none."""

    def __init__(self, byte: dict[str, int]):
        self.byte = byte

    def __missing__(self, seen: str) -> str:
        try:
            c = bytes(self.byte[x] for x in seen).decode("utf-8")
        except UnicodeDecodeError:
            c = seen
        if len(self) >= 1 << 16:
            self.clear()
        self[seen] = c
        return c


@lru_cache(maxsize=1)
def _sequence_kinds() -> dict[str, tuple[np.ndarray, re.Pattern, _Decoded]]:
    """Page -> (what each character number stands for: 1 a continuation, 2 to 4 the first of so many bytes; pattern; characters)."""
    out = {}
    for page, (pattern, byte) in _utf8().items():
        kind = np.zeros(_WIDTH, np.int8)
        for c, b in byte.items():
            kind[_ids()[ord(c)]] = 1 if b <= 0xBF else 0 if b < 0xC2 or b > 0xF4 else 2 if b <= 0xDF else 3 if b <= 0xEF else 4
        out[page] = kind, pattern, _Decoded(byte)
    return out


@lru_cache(maxsize=1 << 17)
def _undo_utf8(word: str, page: str) -> tuple[str, list[tuple[str, str]]]:
    _, pattern, decoded = _sequence_kinds()[page]
    pairs = []

    def letter(m: re.Match) -> str:
        if (c := decoded[m[0]]) != m[0]:
            pairs.append((m[0], c))
        return c

    return pattern.sub(letter, word), pairs


def _undone(words: list[str]) -> dict[str, list[tuple[str, str]]]:
    """Word -> (page, word with its UTF-8 sequences as read with that page undone), for the words and all that comes of them."""
    out: dict = {}
    while words:
        out.update((w, []) for w in words)
        x = encode(" " + " ".join(words) + " ")
        of = np.repeat(np.arange(len(words)), [len(w) + 1 for w in words])
        for page, (kind, pattern, decoded) in _sequence_kinds().items():
            k = kind[x]
            then = k == 1
            begins = (k > 1)[:-1] & then[1:]
            for far in (2, 3):  # first bytes of longer sequences need more continuations
                begins[: len(k) - far] &= (k[:-far] <= far) | then[far:]
            at = np.unique(of[np.flatnonzero(begins[: len(of)])])
            if len(at):
                there = [words[j] for j in at.tolist()]
                for w, r in zip(there, pattern.sub(lambda m: decoded[m[0]], " ".join(there)).split(" ")):  # noqa: B023
                    if r != w:
                        out[w].append((page, r))
        words = list(dict.fromkeys(r for w in words for _, r in out[w] if r not in out))
    return out


def _nested(words: list[str]) -> list[tuple[int, str, str]]:
    """(place of the word, pages, restored word) of every way to undo UTF-8 read with another page, as many times over as it goes; each time shortens the word."""
    out, undone = [], _undone(words)
    for j, word in enumerate(words):
        if not undone[word]:
            continue
        seen, todo = {word}, [(word, "")]
        while todo:
            w, name = todo.pop()
            for page, r in undone[w]:
                if r not in seen:
                    seen.add(r)
                    out.append((j, n := f"{name}+{page}<utf8" if name else f"{page}<utf8", r))
                    todo.append((r, n))
    return out


MARGIN = 25.0  # a reading so much worse than the best one of its word weighs nothing, whatever the shares of its pages (at least FLOOR)
Reading = tuple[tuple[str, ...], str]  # names of the page pairs that read a word alike, and the reading


def candidates(letters: Letters, words: list[str], least: float) -> dict[str, list[Reading]]:
    """Word -> (names of pages, restored word) of readings that fit better by at least `least`; only words that have some.

    Swaps of single bytes are scored for all words at once, over the distinct bigrams that any of them turns. Pairs of pages that read
    a word alike are all named.
    """
    found: dict = {}
    names, turns, moved, code, mixed = list(swaps()), *_swap_ids()
    for k in range(0, len(words), 20_000):
        part = words[k : k + 20_000]
        size = np.array([len(w) for w in part])
        ends = np.cumsum(size + 1)
        starts, of = ends - size - 1, np.repeat(np.arange(len(part)), size + 1)
        codes = np.frombuffer((" " + " ".join(part) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
        x = _ids()[codes]
        move = moved[x]
        kept, chars = np.flatnonzero(move[:-1] | move[1:]), np.flatnonzero(move)
        at, begins = np.unique(of[kept], return_index=True)  # words that some swap turns, and where their bigrams and characters begin
        gain, mark = np.zeros((len(names), len(at)), np.float32), np.zeros((len(names), len(at)), np.uint64)
        if len(at):
            uniq, inverse = np.unique(x[kept].astype(np.int64) * _WIDTH + x[kept + 1], return_inverse=True)
            base, a, b = letters.each(uniq), uniq // _WIDTH, uniq % _WIDTH
            kinds, inverse_chars = np.unique(x[chars], return_inverse=True)
            begins_chars = np.unique(of[chars], return_index=True)[1]
            for i, t in enumerate(turns):
                turned = t[a] * _WIDTH + t[b]
                diff = np.where(turned == uniq, 0, letters.each(turned) - base).astype(np.float32)
                gain[i] = np.add.reduceat(diff[inverse], begins)
                mark[i] = np.add.reduceat(mixed[i][kinds][inverse_chars], begins_chars)  # the same for swaps that turn a word alike
            gain[:, [not _ANY_LETTER.search(part[j]) for j in at.tolist()]] = -np.inf  # signs that stand alone are no evidence
        best, options = np.zeros(len(part)), defaultdict(list)
        if len(at):
            best[at] = np.maximum(gain.max(0), 0)
        nested = _nested(part)
        if nested:
            on = np.array([j for j, _, _ in nested])
            more = letters.scores([r for _, _, r in nested]) - letters.scores(part)[on]
            np.maximum.at(best, on, np.where(more > least, more, 0))
            for q in np.flatnonzero((more > least) & (more > best[on] - MARGIN)).tolist():
                j, name, r = nested[q]
                options[j].append(((name,), r))
        w, i = np.nonzero(((gain > least) & (gain > best[at] - MARGIN)).T)
        order = np.lexsort((i, m := mark[i, w], w))
        w, i, m = w[order], i[order], m[order]
        heads = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (m[1:] != m[:-1])])) if len(w) else np.zeros(0, np.int64)
        tails, known = np.concatenate([heads[1:], [len(w)]]), {}
        by, word = i[heads], at[w[heads]]
        done = np.cumsum(size[word])
        cuts = np.unique([0, *np.searchsorted(done, np.arange(2_000_000, done[-1] if len(done) else 0, 2_000_000)), len(heads)])
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):  # readings are made side by side, some characters at a time
            long = size[word[lo:hi]]
            to = np.cumsum(long)
            place = np.repeat(starts[word[lo:hi]] + 1 - to + long, long) + np.arange(to[-1])
            ids = x[place]
            text = np.where(moved[ids], code[turns[np.repeat(by[lo:hi], long), ids]], codes[place]).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            for j, n, end, head, tail in zip(word[lo:hi].tolist(), long.tolist(), to.tolist(), heads[lo:hi].tolist(), tails[lo:hi].tolist()):
                if (which := i[head:tail].tobytes()) not in known:
                    known[which] = tuple(names[q] for q in i[head:tail].tolist())
                options[j].append((known[which], text[end - n : end]))
        for j in sorted(options):
            found[part[j]] = sorted(options[j])
    return found


@lru_cache(maxsize=1 << 17)
def _unchained(word: str, name: str) -> str:
    for part in name.split("+"):
        word = _undo_utf8(word, part[:-5])[0]
    return word


def applied(word: str, name: str, table: dict[int, str]) -> str:
    """The word as a chain of pages reads it, or as the learned table does."""
    if name == LEARNED:
        return word.translate(table)
    if not name.endswith("<utf8"):
        return word.translate(swaps()[name])
    return _unchained(word, name)


@lru_cache(maxsize=1 << 16)
def symbols(word: str, name: str) -> list[tuple[str, str]]:
    """Distinct (symbol, letter) pairs by which a page pair reads a word; of nested ones the outermost, of a learned table none: it has its own weights."""
    if name == LEARNED:
        return []
    first = name.split("+")[0]
    if first.endswith("<utf8"):
        return sorted(set(_undo_utf8(word, first[:-5])[1]))
    table = swaps()[first]
    return sorted({(c, table[ord(c)]) for c in word if ord(c) in table})


# -- expectation-maximization --------------------------------------------------------------------------------------------------


class Prices(dict):
    """Character -> log probability, in a source, of what a swap turns it into; 0 where it leaves it."""

    def __init__(self, model: Model, source: str, table: dict[int, str]):
        self.model, self.source, self.table = model, source, table

    def __missing__(self, c: str) -> float:
        letter = self.table.get(ord(c))
        self[c] = 0.0 if letter is None else self.model.price(self.source, c, letter)
        return self[c]


class Model:
    """Letter bigrams, share of garbled words per source and page pair, and what symbols mean there."""

    def __init__(self, letters: Letters, first: Letters | None = None):
        self.letters = letters
        self.first = first or letters  # the first bigrams, by which free mappings were learned and are judged
        self.share: dict = {}  # (source, page pair) -> weight among all words of the source
        self.meaning: dict = {}  # (symbol, letter) -> probability, over all sources as far as a source has not seen it
        self.own: dict = {}  # (source, symbol, letter) -> probability
        self.tables: dict = {}  # (source, language) -> translate() table that was learned freely
        self.prices: dict = {}  # (source, swap) -> Prices, filled as words are weighed

    def weigh(self, source: str, words: list[str], options: list[list[Reading]], least: float = 0.0, by_first: bool = False) -> list[list[tuple[tuple[str, ...], str, float]]]:
        """For each word its (names, restored word, log odds against leaving it as it is), those whose bigrams gain more than `least` only.

        Learned tables are judged by the first bigrams, all readings if `by_first`.
        """
        score, own, out = {}, {}, []
        for letters, first in ((self.letters, False), (self.first, True)):
            flat = {r for o in options for names, r in o if (by_first or names[0] == LEARNED) == first}
            if flat:
                flat = list(flat)
                score[first] = dict(zip(flat, letters.scores(flat).tolist()))
                own[first] = letters.scores(words).tolist()
        for k, (w, o) in enumerate(zip(words, options)):
            kept = []
            for names, r in o:
                name = names[0]
                first = by_first or name == LEARNED
                gain = score[first][r] - own[first][k]
                if gain > least:  # pages that read a word alike turn the same symbols
                    if name == LEARNED:
                        pass
                    elif name.endswith("<utf8"):
                        gain += CHANCE + sum([self.price(source, *pair) for pair in symbols(w, name)])
                    else:
                        prices = self.prices.get((source, name)) or self._prices(source, name)
                        gain += sum([prices[c] for c in dict.fromkeys(w)])
                    kept.append((names, r, gain))
            out.append(kept)
        return out

    def price(self, source: str, symbol: str, letter: str) -> float:
        return log(self.own.get((source, symbol, letter)) or self.meaning.get((symbol, letter), 0.3))

    def _prices(self, source: str, name: str) -> Prices:
        if len(self.prices) >= 1 << 12:
            self.prices.clear()
        return self.prices.setdefault((source, name), Prices(self, source, swaps()[name]))

    def weight(self, source: str, name: str) -> float:
        return max(self.share.get((source, name)) or self.share.get(("", name), 0.0), FLOOR if self.share else START)

    def prior(self, source: str, name: str) -> float:
        return log(self.weight(source, name))


def _split(text: str) -> list[str]:
    """Runs between ASCII white space; other blanks may be symbols and part nothing."""
    return _SPLIT.split(text) if _BLANK.search(text) else text.split()


def _words(text: str) -> list[str]:
    return [w for w in _split(text) if w and not w.isascii()]


LEAST_GAIN = 2.0


# fixed values: letters beyond ASCII of the languages that are told apart, and plain words by which each is known
ALPHABETS = {"en": "", "de": "äöüß", "fr": "àâæçèéêëîïôùûüÿœ", "es": "áéíñóúü", "pt": "àáâãçéêíóôõú", "pl": "ąćęłńóśźż", "ru": "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"}
KNOWN_BY = {
    "en": "the and of to is for with that this are from", "de": "der die das und ist nicht mit von ein eine auf den dem wird", "fr": "le les et est dans pour une des du sur avec aux",
    "es": "el los las con del en como esta", "pt": "os uma com do da em ao dos no", "pl": "nie jest na oraz przez dla od i z w",
}
QUOTES = "“”‘’«»„…–—"
LEARNED = "learned"


@lru_cache(maxsize=1)
def _known_by() -> dict[str, str]:
    return {w: lang for lang, words in KNOWN_BY.items() for w in words.split()}


def language(text: str, words: list[str] | None = None) -> str:
    """The language whose plain words stand in a text most often, ru for Cyrillic without any, else ''."""
    known = _known_by()
    hits = Counter([known[w] for w in (text.split() if words is None else words) if w in known])
    if hits and (top := hits.most_common(1)[0])[1] > 1:
        return top[0]
    return "ru" if len(re.findall("[а-яё]", text)) > 2 else ""


@lru_cache(maxsize=32)
def _own(lang: str) -> re.Pattern:
    """Words of a language, or Cyrillic ones: its own letters, capitals only where a word begins, and quotation marks."""
    one = lambda low, more: f"(?:[{more}{QUOTES}]|[{low}]|(?<![\\w])[{low.upper().replace('SS', '')}])*" if low else f"[{more}{QUOTES}]*"
    return re.compile(f"{one(ALPHABETS.get(lang, ''), chr(0) + '-' + chr(127))}|{one(ALPHABETS['ru'], chr(0) + '-@')}")


@lru_cache(maxsize=1 << 17)
def is_own(lang: str, word: str) -> bool:
    return bool(_own(lang).fullmatch(word))


def vocabulary(texts: DataFrame) -> DataFrame:
    """(source, lang, word, n): all words that are not plain ASCII with their number of uses in documents of a language."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            count: Counter = Counter()
            for source, text in zip(pdf["source"], pdf["text"]):
                if text and not text.isascii():
                    words = _split(text)
                    lang = language(text, words)
                    for w in words:
                        if not w.isascii():
                            count[source, lang, w] += 1
            yield pd.DataFrame([(*k, n) for k, n in count.items()], columns=["source", "lang", "word", "n"])

    keys = ["source", "lang", "word"]
    rows = texts.select("source", "text").mapInPandas(run, "source string, lang string, word string, n long").groupBy(*keys).agg(F.sum("n").alias("n"))
    return rows.repartition("word").sortWithinPartitions("word")  # a word of many sources is read once in a batch


PLAUSIBLE = -8.0  # the rarest bigram of a reading by the first bigrams, which lack some correct ones


def start(keys: np.ndarray, counts: np.ndarray, table: DataFrame) -> Model:
    """The first model: bigrams of ASCII words and of words that only hold letters of the language of their document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict = defaultdict(float)
        for pdf in batches:
            odd = [(w, n) for lang, w, n in zip(pdf["lang"], pdf["word"], pdf["n"]) if not is_own(lang, w)]
            _add_bigrams([w for w, _ in odd], [n for _, n in odd], sums)
        yield pd.DataFrame(list(sums.items()), columns=["key", "v"])

    got = table.mapInPandas(run, "key long, v double").groupBy("key").agg(F.sum("v").alias("v")).toPandas()
    return Model(Letters(keys, np.maximum(counts - got.set_index("key")["v"].reindex(keys).fillna(0).to_numpy(), 0)))


# -- free mappings -------------------------------------------------------------------------------------------------------------

FREE_ROUNDS = 5
LEAST_SYMBOLS, LEAST_USES = 3, 3.0  # a learned table maps so many symbols, each used so often; a lone foreign letter is no cipher
SURE = 0.6  # probability from which a symbol is translated


_COMBINED = re.compile("[\u0300-\u036f]")  # letters written as two characters are correct


class Free:
    """What symbols mean, per (source, language): rows (symbol, letter, v) of expected uses, also over all sources."""

    def __init__(self, rows: pd.DataFrame):
        self.own = {k: part.set_index(["symbol", "letter"])["v"] for k, part in rows.groupby(["source", "lang"])}
        self.all = {k: part.groupby(["symbol", "letter"])["v"].sum() for k, part in rows.groupby("lang")}

    def table(self, source: str, lang: str, symbols_: list[str], letters_: list[str]) -> np.ndarray:
        """Probability of each letter for each symbol: (symbols, letters). Unseen symbols may mean anything, own letters mostly themselves."""
        index = pd.MultiIndex.from_product([symbols_, letters_])
        first = np.array([[1.0 if s == c else 0.0 for c in letters_] for s in symbols_])
        own = np.array([s.lower() in ALPHABETS[lang] for s in symbols_])[:, None]
        free = np.array([c.lower() in ALPHABETS[lang] for c in letters_])[None, :]
        first = np.where(own, 0.9, 0.2) * first + np.where(own, 0.1, 0.8) * free / max(1, free.sum())
        for counts in (self.all.get(lang), self.own.get((source, lang))):
            if counts is not None:
                v = counts.reindex(index).fillna(0).to_numpy().reshape(first.shape)
                first = (v + 5 * first) / (v.sum(1, keepdims=True) + 5)
        return first


def _forward_backward(letters: Letters, words: list[str], ns: list[int], lang: str, probability) -> tuple[list[str], list[str], np.ndarray]:
    """(symbols, letters, expected uses): posterior of the letter behind every symbol of the words, whose ASCII characters stand for themselves.

    probability(symbols, letters) gives the mapping so far. All words are passed at once, character by character.
    """
    seen = sorted({c for w in words for c in w} | {" "})
    odd = [c for c in seen if c > "\x7f"]
    chars = sorted({c for c in seen if c <= "\x7f"} | set(odd) | set(ALPHABETS[lang]) | set(ALPHABETS[lang].upper().replace("SS", "")))
    at, place = {c: k for k, c in enumerate(chars)}, {c: k for k, c in enumerate(seen)}
    x = encode("".join(chars)).astype(np.int64)
    step = np.exp(letters.each((x[:, None] * _WIDTH + x[None, :]).ravel()).reshape(len(x), len(x)).astype(np.float64))
    emit = np.zeros((len(seen), len(chars)))
    for c in seen:
        if c <= "\x7f":
            emit[place[c], at[c]] = 1
    if odd:
        emit[[place[c] for c in odd]] = probability(odd, chars)
    uses = np.zeros((len(seen), len(chars)))
    for k in range(0, len(words), 1024):
        part, n = words[k : k + 1024], np.array(ns[k : k + 1024], float)
        long = max(map(len, part)) + 2
        w = np.full((len(part), long), place[" "])
        for i, word in enumerate(part):
            w[i, 1 : len(word) + 1] = [place[c] for c in word]
        ahead, state = [], emit[w[:, 0]]
        for t in range(long):
            state = emit[w[:, t]] * (state @ step if t else 1)
            state = state / np.maximum(state.sum(1, keepdims=True), 1e-300)
            ahead.append(state)
        back = np.ones_like(state)
        for t in range(long - 1, -1, -1):
            post = ahead[t] * back
            np.add.at(uses, w[:, t], post / np.maximum(post.sum(1, keepdims=True), 1e-300) * n[:, None])
            back = (emit[w[:, t]] * back) @ step.T
            back = back / np.maximum(back.sum(1, keepdims=True), 1e-300)
    return odd, chars, uses[[place[c] for c in odd]]


def suspects(spark, table: DataFrame, model: Model) -> DataFrame:
    """Rows of the vocabulary that may be garbled, with `unread`: words of foreign letters that no known pair of pages reads plausibly.

    A word that only holds letters of its language, capitals in front, is settled: it is no evidence, whatever it could be turned into. Of the
    others one stays if a reading fits better by the first bigrams, if it holds foreign letters, or a lost character. The
    first bigrams know no garbled words, so what fits none better is settled for all rounds.
    """
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            letters = shared.value.letters
            pdf = pdf[np.array([not is_own(lang, w) for lang, w in zip(pdf["lang"], pdf["word"])], bool)]
            better = candidates(letters, pdf["word"].unique().tolist(), LEAST_GAIN)
            read = letters.plausible(better, PLAUSIBLE)
            lost = np.array([bool(_LOST.search(w)) for w in pdf["word"]], bool)
            foreign = np.array([bool(ALPHABETS.get(lang)) and not is_own(lang, w.lower()) and not _COMBINED.search(w) for lang, w in zip(pdf["lang"], pdf["word"])], bool)
            unread = foreign & ~lost & np.array([w not in read for w in pdf["word"]], bool)
            yield pdf.assign(unread=unread)[foreign | lost | np.array([w in better for w in pdf["word"]], bool)]

    return cut(table.mapInPandas(run, "source string, lang string, word string, n long, unread boolean"))


def learn_freely(spark, table: DataFrame, model: Model) -> dict:
    """(source, language) -> translate() table, from the unread words of the table.

    Expectation-maximization from scratch: mappings per source lean on that over all sources. Words are dealt over tasks, sums come back
    per source, language, symbol and letter.
    """
    shared = spark.sparkContext.broadcast(model)
    words = cut(table.where("unread").drop("unread").repartition("source", "lang", F.pmod(F.xxhash64("word"), F.lit(16))))
    got = pd.DataFrame(columns=["source", "lang", "symbol", "letter", "v"])
    for _ in range(FREE_ROUNDS if not words.isEmpty() else 0):
        before = spark.sparkContext.broadcast(Free(got))

        def expect(batches: Iterator[pd.DataFrame], before=before) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for (source, lang), part in pdf.groupby(["source", "lang"]):
                    table_of = lambda s, c, source=source, lang=lang: before.value.table(source, lang, s, c)
                    odd, chars, uses = _forward_backward(shared.value.letters, part["word"].tolist(), part["n"].tolist(), lang, table_of)
                    i, j = np.nonzero(uses > 1e-2)
                    yield pd.DataFrame({"source": source, "lang": lang, "symbol": [odd[k] for k in i], "letter": [chars[k] for k in j], "v": uses[i, j]})

        keys = ["source", "lang", "symbol", "letter"]
        got = words.mapInPandas(expect, "source string, lang string, symbol string, letter string, v double").groupBy(*keys).agg(F.sum("v").alias("v")).toPandas()
    return _tables(got)


def _tables(got: pd.DataFrame) -> dict:
    """The likeliest letters of sure symbols, per source and language, and under source '' over all sources."""
    over = got.groupby(["lang", "symbol", "letter"], as_index=False)["v"].sum()
    out: dict = {}
    for rows in (got, over.assign(source="")):
        keys = ["source", "lang", "symbol"]
        total = rows.groupby(keys)["v"].transform("sum")
        sure = rows[(rows["v"] >= SURE * total) & (total >= LEAST_USES) & (rows["symbol"] != rows["letter"])]
        for (source, lang), part in sure.groupby(["source", "lang"]):
            if len(part) >= LEAST_SYMBOLS:
                out[source, lang] = {ord(s): c for s, c in zip(part["symbol"], part["letter"])}
    return {k: out.get(("", k[1]), {}) | t for k, t in out.items()}


@lru_cache(maxsize=1)
def _swap_ids() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By character numbers: what each swap makes of them, whether any turns them, their characters, and a random mark of each turn."""
    ids, code = _ids(), np.zeros(_WIDTH, np.uint32)
    turns = np.tile(np.arange(_WIDTH, dtype=np.int64), (len(swaps()), 1))
    for t, table in zip(turns, swaps().values()):
        for c, letter in table.items():
            t[ids[c]] = ids[ord(letter)]
            code[ids[ord(letter)]], code[ids[c]] = ord(letter), c
    mixed = np.random.default_rng(8).integers(0, 1 << 64, _WIDTH, np.uint64)
    odd = np.random.default_rng(9).integers(0, 1 << 64, _WIDTH, np.uint64)
    return turns, (turns != np.arange(_WIDTH)).any(0), code, mixed[turns] * (odd | np.uint64(1))


# characters that no correct text holds
_LOST = re.compile("[�\x80-\x9f￾￿\U000f0000-\U0010ffff]")


def _expect(m: Model, source: str, words: list[str], ns: list[int], weighed: list[list[tuple[tuple[str, ...], str, float]]], sums: dict) -> tuple[list[str], list[float]]:
    """E-step for the words of a source with n uses each: adds the weights of their readings to the sums; (garbled words, their garbled uses)."""
    weights, spoilt, uses = {}, [], []
    for w, n, options in zip(words, ns, weighed):
        logs = []
        for names, _, g in options:
            if names not in weights:
                v = [m.weight(source, name) for name in names]
                weights[names] = v, sum(v), log(sum(v))
            logs.append(g + weights[names][2])
        top = max([0.0, *logs])
        z = exp(-top) + sum([exp(x - top) for x in logs])
        garbled = 0.0
        for (names, _, _), x in zip(options, logs):
            p = exp(x - top) / z
            if p < 1e-4:
                continue
            garbled += p
            v, whole, _ = weights[names]
            for name, u in zip(names, v):
                sums["share", source, name, "", 0] += n * p * u / whole
            for s, c in symbols(w, names[0]):
                sums["meaning", source, s, c, 0] += n * p
        lost = _LOST.search(w)
        if garbled > 1e-3 or lost:
            spoilt.append(w)
            uses.append(n * (1.0 if lost else garbled))
    return spoilt, uses


def learn(spark, texts: DataFrame):
    """Fit the model to (source, text): bigrams of everything, free mappings, then EM over the readings of words."""
    counted = cut(bigrams(texts)).toPandas()  # at most as many as pairs of characters in the fixed range, and a row for each source
    sizes = counted[counted["key"] == -1]
    totals = dict(zip(sizes["source"], sizes["n"].astype(float)))
    counted = counted[counted["key"] != -1]
    keys, counts = counted["key"].to_numpy(), counted["n"].to_numpy().astype(float)
    table = cut(vocabulary(texts))
    model = start(keys, counts, table)
    table = suspects(spark, table, model)
    tables = learn_freely(spark, table, model)
    everything = {**totals, "": max(sum(totals.values()), 1.0)}
    for _ in range(ROUNDS):
        model.tables = tables
        shared = spark.sparkContext.broadcast(model)

        def expect(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            sums, spoilt = defaultdict(float), defaultdict(float)
            m = shared.value
            for pdf in batches:
                better = candidates(m.letters, pdf["word"].unique().tolist(), LEAST_GAIN)
                if not m.share:
                    better = m.letters.plausible(better, PLAUSIBLE)
                freely = learned_readings(m, zip(pdf["source"], pdf["lang"], pdf["word"]))
                odd = pdf[[w in better or (s, w) in freely or bool(_LOST.search(w)) for s, w in zip(pdf["source"], pdf["word"])]]
                for source, part in odd.groupby("source"):
                    words, ns = part["word"].tolist(), part["n"].tolist()
                    weighed = m.weigh(source, words, [better.get(w, []) + freely.get((source, w), []) for w in words])
                    _add_bigrams(*_expect(m, source, words, ns, weighed, sums), spoilt)
            sums.update((("bigram", "", "", "", key), v) for key, v in spoilt.items())
            yield pd.DataFrame([(*k, v) for k, v in sums.items()], columns=["what", "source", "a", "b", "key", "v"])

        got = table.drop("unread").mapInPandas(expect, "what string, source string, a string, b string, key long, v double").groupBy("what", "source", "a", "b", "key").agg(F.sum("v").alias("v")).toPandas()
        model = _next(keys, counts, got, everything, model.first)
    model.tables = tables
    return spark.sparkContext.broadcast(model)


def learned_readings(m: Model, rows) -> dict[tuple[str, str], list[Reading]]:
    """(source, word) -> its reading by the learned table of source and language, for (source, language, word)."""
    read, tables, turns = {}, {}, {}
    for source, lang, w in rows:
        if (source, lang) not in tables:
            tables[source, lang] = m.tables.get((source, lang)) or m.tables.get(("", lang), {})
            turns[source, lang] = {chr(c) for c in tables[source, lang]}
        table = tables[source, lang]
        if table and not turns[source, lang].isdisjoint(w):
            read[source, w] = [((LEARNED,), w.translate(table))]
    return read


def _next(keys: np.ndarray, counts: np.ndarray, got: pd.DataFrame, totals: dict, first: Letters | None = None) -> Model:
    """M-step: bigrams without the garbled words, shares of page pairs, meanings of symbols overall and per source."""
    spoilt = got[got["what"] == "bigram"]
    clean = counts - pd.Series(spoilt["v"].to_numpy(), index=spoilt["key"].to_numpy()).reindex(keys).fillna(0).to_numpy()
    model = Model(Letters(keys, np.maximum(clean, 0)), first)
    shares = got[got["what"] == "share"]
    overall = shares.groupby("a")["v"].sum() / totals[""]
    model.share = {("", name): v for name, v in overall.items()}
    own = (shares["v"] + 20 * shares["a"].map(overall)) / (shares["source"].map(totals) + 20)
    model.share |= dict(zip(zip(shares["source"], shares["a"]), own))
    m = got[got["what"] == "meaning"]
    both = m.groupby(["a", "b"])["v"].sum()
    both = (both + 0.3) / (m.groupby("a")["v"].sum().reindex(both.index.get_level_values(0)).to_numpy() + 1)
    model.meaning = both.to_dict()
    lean = both.reindex(pd.MultiIndex.from_frame(m[["a", "b"]])).to_numpy()
    own = (m["v"] + 5 * lean) / (m.groupby(["source", "a"])["v"].transform("sum") + 5)
    model.own = dict(zip(zip(m["source"], m["a"], m["b"]), own))
    return model


# -- documents -----------------------------------------------------------------------------------------------------------------


ALONE = 6.0  # further log odds that a document needs whose only evidence is a learned table, and words that show it
LEAST_WORDS, LEAST_READ = 4, 0.4  # so many words, and such a share of those with its symbols, a learned table has to read plausibly


def judge(model: Model, source: str, lang: str, words: list[str], odd: list[str], known: dict) -> tuple[float, dict[str, str], set[str]]:
    """(log odds that a text of these words is garbled, word -> restored word, pages); known: (source, word) -> weighed readings.

    Only odd words, those with letters foreign to the language of the text, are evidence; where they tell enough all words are read again.

    Words of one pair of pages support each other: its price is paid once for the document, and a little for each word. A learned
    table also has to read most words that hold its symbols.
    """
    sums, n = defaultdict(float), Counter()
    shown = defaultdict(dict)
    for w in odd:
        for names, _, g in known.get((source, w), ()):
            if g > 1:
                for name in names:
                    shown[name][w] = g - 1
    for name, by_word in shown.items():
        sums[name], n[name] = sum(by_word.values()), len(by_word)
    odds = {name: v + model.prior(source, name) + float(np.log(RUN)) for name, v in sums.items()}
    table = model.tables.get((source, lang)) or model.tables.get(("", lang), {})
    if LEARNED in odds:
        odds[LEARNED] -= ALONE
        turned = {w: [((LEARNED,), r)] for w in words if (r := w.translate(table)) != w}
        if min(n[LEARNED], len(model.first.plausible(turned, PLAUSIBLE))) < max(LEAST_WORDS, LEAST_READ * len(turned)):
            odds[LEARNED] = -9.0
    good, told = [], set()
    for name in sorted((name for name, v in odds.items() if v > FOUND), key=lambda name: (-odds[name], name)):
        if sum(v for w, v in shown[name].items() if w not in told) + odds[name] - sums[name] > FOUND:  # what better pages do not read pays its price too
            good.append(name)
            told.update(shown[name])
    restored = reread(model, source, words, good, table, odds) if good else {}
    return max([-9.0, *odds.values()]), {w: r for w, (_, r) in restored.items()}, {name for name, _ in restored.values()}


def reread(model: Model, source: str, words: list[str], good: list[str], table: dict[int, str], odds: dict) -> dict[str, tuple[str, str]]:
    """Word -> (pages, restored word) in a document that these pages garbled: how much of it they garbled is settled by EM over its words."""
    options = [[((name,), r) for name in good if (r := applied(w, name, table)) != w] for w in words]
    weighed = [(w, o) for w, o in zip(words, model.weigh(source, words, options, -60.0, True)) if o]
    if not weighed:
        return {}
    order = sorted(good, key=lambda name: (odds[name], (name,)), reverse=True)  # among equals the first is taken
    column = {name: k for k, name in enumerate(order)}
    gains = np.full((len(weighed), len(good)), -np.inf)
    for j, (_, o) in enumerate(weighed):
        for (name,), _, g in o:
            gains[j, column[name]] = g
    share = np.full(len(good), 0.5 / len(good))
    for _ in range(5):
        left = log(max(1e-3, 1 - share.sum()))
        logs = gains + np.log(share)
        top = np.maximum(logs.max(1), left)
        p = np.exp(logs - top[:, None])
        whole = p.sum(1) + np.exp(left - top)
        best, mass = p.argmax(1), (p / whole[:, None]).sum(0)
        kept = logs[np.arange(len(best)), best] > left
        share = (mass + 0.5 / len(good)) / ((1 - p.sum(1) / whole).sum() + mass.sum() + 1)
    out = {}
    for (w, o), k, keep in zip(weighed, best.tolist(), kept.tolist()):
        if keep:
            out[w] = next((name, r) for (name,), r, _ in o if name == order[k])
    return out


def restore(docs: DataFrame) -> DataFrame:
    """(doc_id, log_odds, pages, n_words, is_whole, text) of the documents found to be garbled.

    docs: (doc_id, source, text). text is the restored text; is_whole tells that no trace is left. Characters that were lost (U+FFFD)
    cannot come back: such documents are found, with what could be restored. Null, empty and plain ASCII texts are never found.
    Sources are kept apart as they are spelt; a null source is one of its own. Equal rows give equal rows.
    """
    spark = docs.sparkSession
    let_workers_import(spark)
    docs = docs.select("doc_id", F.coalesce(F.lower(F.trim("source")), F.lit("?")).alias("source"), "text").where("text is not null")
    model = learn(spark, docs.select("source", "text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = model.value
            cells = [(i, s, t, _split(t)) for i, s, t in zip(pdf["doc_id"], pdf["source"], pdf["text"]) if not t.isascii()]
            texts = [(i, s, language(t, ws), t, [w for w in dict.fromkeys(ws) if not w.isascii()]) for i, s, t, ws in cells]
            odd = [[w for w in ws if not is_own(lang, w)] for _, _, lang, _, ws in texts]
            better = candidates(m.letters, list({w for ws in odd for w in ws}), 0.5)
            freely = learned_readings(m, [(s, lang, w) for (_, s, lang, _, _), ws in zip(texts, odd) if (s, lang) in m.tables or ("", lang) in m.tables for w in ws])
            used = defaultdict(set)
            for (_, s, _, _, _), ws in zip(texts, odd):
                used[s].update(w for w in ws if w in better or (s, w) in freely)
            known = {}
            for s, ws in used.items():
                ws = sorted(ws)
                known.update(zip([(s, w) for w in ws], m.weigh(s, ws, [better.get(w, []) + freely.get((s, w), []) for w in ws])))
            rows = []
            for (i, source, lang, text, ws), sus in zip(texts, odd):
                lost = bool(_LOST.search(text))
                if not lost and not any((source, w) in known for w in sus):
                    continue
                odds, words, pages = judge(m, source, lang, ws, sus, known)
                odds = 99.0 if lost else odds
                if odds > FOUND:
                    fixed = re.sub(r"[^ \t\n\r\f\v]+", lambda x: words.get(x[0], x[0]), text) if words else text
                    rows.append((i, odds, ",".join(sorted(pages)), len(words), not _LOST.search(fixed), fixed))
            yield pd.DataFrame(rows, columns=["doc_id", "log_odds", "pages", "n_words", "is_whole", "text"])

    return docs.mapInPandas(run, "doc_id long, log_odds double, pages string, n_words long, is_whole boolean, text string")
