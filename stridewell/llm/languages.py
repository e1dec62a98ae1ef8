"""Languages of documents and of the stretches within them, by error-correcting output codes.

Every language has a codeword of bits. For each bit, a binary naive Bayes classifier on hashed n-grams of words says
whether a sentence belongs to the languages whose bit is one. Decoding sums, over the bits, a loss of the classifier's
margin against each codeword, weighted by how reliable the bit proved on the sample, and takes the language of the
smallest sum. So a few wrong bits do no harm. Where no codeword is near, the language is `OTHER`.

A text is cut into sentences, and every sentence with a letter is decoded, however short. A change of language within a
text has a price, so a sentence that says little takes the language around it. The languages are those that the labels
name. The classifiers are fitted on a bounded sample of labelled documents; labels may be wrong, so the sample's
sentences are relabelled by the decoder and the fit is repeated.

A batch of texts is one array of code points: cutting, folding and hashing are whole-array operations, and n-grams are
looked up once for each different word of the batch.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import require_columns

# Two-letter codes, three-letter codes and English names of languages that a label may name.
LANGUAGES = {
    "ar": ("ara", "arabic"),
    "bg": ("bul", "bulgarian"),
    "ca": ("cat", "catalan"),
    "cs": ("ces", "cze", "czech"),
    "da": ("dan", "danish"),
    "de": ("deu", "ger", "german"),
    "el": ("ell", "gre", "greek"),
    "en": ("eng", "english"),
    "es": ("spa", "spanish"),
    "fa": ("fas", "per", "persian"),
    "fi": ("fin", "finnish"),
    "fr": ("fra", "fre", "french"),
    "he": ("heb", "hebrew"),
    "hi": ("hin", "hindi"),
    "hr": ("hrv", "croatian"),
    "hu": ("hun", "hungarian"),
    "id": ("ind", "indonesian"),
    "it": ("ita", "italian"),
    "ja": ("jpn", "japanese"),
    "ko": ("kor", "korean"),
    "nb": ("nob", "norwegian"),
    "nl": ("nld", "dut", "dutch"),
    "pl": ("pol", "polish"),
    "pt": ("por", "portuguese"),
    "ro": ("ron", "rum", "romanian"),
    "ru": ("rus", "russian"),
    "sk": ("slk", "slo", "slovak"),
    "sv": ("swe", "swedish"),
    "th": ("tha", "thai"),
    "tr": ("tur", "turkish"),
    "uk": ("ukr", "ukrainian"),
    "vi": ("vie", "vietnamese"),
    "zh": ("zho", "chi", "chinese"),
}
OTHER = "other"
BINS = 1 << 16
SIZES = (2, 3, 4, 5)
#: The sample that the classifiers are fitted on: documents, leading characters and sentences of each, sentences of a language.
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLE_SENTENCES, PER_LANGUAGE = 8_000, 4_000, 12, 10_000
#: Documents of the sample that must be labelled with a language before it gets a codeword.
LEAST_DOCS = 5
#: A capitalised word is often a name, which says little about the language of the sentence: its share of a full word.
NAME_WEIGHT = 0.25
#: Price of a change of language within a text, and the loss from which no codeword counts as near.
CHANGE, FAR = 0.35, 0.33
#: Features of a sentence at which its losses count by half: a few words say little.
EVIDENCE = 200
#: Share of a full loss from which a sentence may count as being in none of the languages.
LEAST_SAID = 0.33
#: Lead over the second-best language below which a stretch is ambiguous.
LEAST_LEAD = 0.05
#: Characters worked on at once; longer texts are cut at a space.
PIECE = 400_000


def label_language(label: Column) -> Column:
    """Two-letter code that a delivered label names (code or English name, any case, with or without region), or null."""
    known = {n: c for c, names in LANGUAGES.items() for n in (c, *names)}
    plain = F.lower(F.regexp_extract(label, r"^\s*([A-Za-z]+)\s*(?:[-_][A-Za-z0-9]+\s*)*$", 1))
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.when(label.isNotNull(), table[plain])


# --- characters -----------------------------------------------------------------------------------------------------

_BLANK, _LETTER, _SPACE, _LINE, _END, _CLOSE, _CODE, _GONE, _DIGIT, _BAR, _OPEN = range(11)
_TOP = 0x20000


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: kind, lower-case letter, the same without accents, and whether it is a capital."""
    kind = np.zeros(_TOP, dtype=np.uint8)
    lower = np.arange(_TOP, dtype=np.uint32)
    bare = lower.copy()
    capital = np.zeros(_TOP, dtype=bool)
    for k in range(_TOP):
        c = chr(k)
        if c.isalpha():
            kind[k] = _LETTER
            capital[k] = c != c.lower()
            low = unicodedata.normalize("NFKC", c).casefold()[:1] or c
            plain = "".join(x for x in unicodedata.normalize("NFKD", low) if not unicodedata.combining(x))[:1] or low
            lower[k], bare[k] = ord(low), ord("i" if plain == "ı" else plain)
        elif c.isspace():
            kind[k] = _SPACE
        elif c.isdecimal():
            kind[k] = _DIGIT
        elif unicodedata.category(c) in ("Mn", "Me", "Cf"):
            kind[k] = _GONE
    for chars, what in (("\r\n\t\v\f\x1c\x1d\x1e\x85\u2028\u2029", _LINE), (".!?…。！？", _END), ("\"'”’»)]}", _CLOSE), ("_={<>\\|@", _CODE), ("/•·", _BAR), ("¿¡", _OPEN)):
        kind[[ord(c) for c in chars]] = what
    return kind, lower, bare, capital


# What the second bytes of UTF-8 look like when they are read as Windows text.
_CP1252 = "ŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™"
_DAMAGE = np.array([ord(x) for x in _CP1252], dtype=np.uint32)
_REPAIR = re.compile(r"&#?\w{1,10};|\\u[0-9a-fA-F]{4}|\\[nrt]|[\u00c2-\u00f4][\u0080-\u00bf" + _CP1252 + "]+")


def _mended(m: re.Match) -> str:
    found = m[0]
    if found[0] == "&":
        return html.unescape(found)
    if found[0] == "\\":
        return chr(int(found[2:], 16)) if found[1] == "u" else "\n"
    for encoding in ("latin-1", "cp1252"):
        try:
            return found.encode(encoding).decode("utf-8")
        except UnicodeError:
            pass
    return found


def repaired(text: str) -> tuple[str, np.ndarray]:
    """The text without entities, escapes and the commonest encoding damage, and where its characters come from."""
    out, places, at = [], [], 0
    for m in _REPAIR.finditer(text):
        new = _mended(m)
        out += [text[at : m.start()], new]
        places += [np.arange(at, m.start()), np.full(len(new), m.start())]
        at = m.end()
    return "".join([*out, text[at:]]), np.concatenate([*places, np.arange(at, len(text))])


def pieces(text: str, most: int = PIECE) -> Iterator[tuple[int, str]]:
    """(offset, text) of the parts of a text that are worked on at once, all of it."""
    at = 0
    while len(text) - at > most:
        end = max(text.rfind("\n", at, at + most), text.rfind(". ", at, at + most) + 1)
        end = end if end > at + most // 2 else max(text.rfind(" ", at, at + most), at + most // 2)
        yield at, text[at:end]
        at = end
    yield at, text[at:]


# --- sentences and words ------------------------------------------------------------------------------------------


@dataclass
class Words:
    """Words of a batch of texts: the sentence of each, its different words, and how much it weighs.

    sentence: number of each word's sentence, rising; kind: which of the different words it is; weight: 1 or less.
    Of each sentence: text (number of its text), start and end (places in it), letters. bins, owner: the features of
    the different words, and the word each belongs to; hashes: of the different words; n_words of each text, code included.
    """

    sentence: np.ndarray
    kind: np.ndarray
    weight: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    bins: np.ndarray
    owner: np.ndarray
    hashes: np.ndarray
    n_words: np.ndarray

    @property
    def n_kinds(self) -> int:
        return len(self.hashes)

    def only(self, keep: np.ndarray) -> Words:
        """The sentences that are marked in `keep`, with the same different words."""
        place = np.cumsum(keep) - 1
        mine = keep[self.sentence]
        return Words(place[self.sentence[mine]], self.kind[mine], self.weight[mine], self.text[keep], self.start[keep], self.end[keep], self.letters[keep], self.bins, self.owner, self.hashes, self.n_words)

    @staticmethod
    def joined(parts: list[Words]) -> Words:
        """Words of one batch after the other; a word of several is one."""
        h, one, which = np.unique(np.concatenate([p.hashes for p in parts]), return_index=True, return_inverse=True)
        before = np.cumsum([0, *(p.n_kinds for p in parts)])
        bins, owner = [], []
        for p, at in zip(parts, before):
            new = which[at : at + p.n_kinds]
            first = one[new] == np.arange(at, at + p.n_kinds)  # its features come from here
            mine = first[p.owner]
            bins.append(p.bins[mine])
            owner.append(new[p.owner[mine]])
        b, o = np.concatenate(bins), np.concatenate(owner)
        order = np.argsort(o, kind="stable")
        sentences, texts = (np.cumsum([0, *(len(getattr(p, c)) for p in parts)]) for c in ("text", "n_words"))
        put = lambda c, add=None: np.concatenate([getattr(p, c) + (0 if add is None else add[k]) for k, p in enumerate(parts)])
        kind = np.concatenate([which[p.kind + at] for p, at in zip(parts, before)])
        return Words(put("sentence", sentences), kind, put("weight"), put("text", texts), put("start"), put("end"), put("letters"), b[order], o[order], h, put("n_words"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def words(texts: list[str]) -> Words:
    """Sentences and words of texts, whole. Tokens that look like code, addresses or names of fields are no words."""
    kinds, lower, bare, capital = _tables()
    fixed: dict[int, np.ndarray] = {}
    for again in (False, True):
        size = np.array([len(t) + 1 for t in texts], dtype=np.int64)
        first = np.cumsum(size) - size
        c = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        odd = (c == 38) | (c == 92)
        odd[:-1] |= (c[:-1] >= 0xC2) & (c[:-1] <= 0xF4) & ((c[1:] >= 0x80) & (c[1:] <= 0xBF) | np.isin(c[1:], _DAMAGE))
        if again or not odd.any():
            break
        texts = list(texts)
        for k in np.unique(np.searchsorted(first, np.flatnonzero(odd), "right") - 1):
            texts[k], fixed[int(k)] = repaired(texts[k])
    c = np.minimum(c, _TOP - 1)
    kind = kinds[c]
    place = None
    if (kind == _GONE).any():
        place = np.flatnonzero(kind != _GONE)
        c, kind = c[place], kind[place]
    n = len(c)
    at = np.arange(n)
    before = np.empty_like(kind)
    before[:1], before[1:] = _LINE, kind[:-1]
    after = np.empty_like(kind)
    after[-1:], after[:-1] = _LINE, kind[1:]
    blank, blank_before = (kind == _SPACE) | (kind == _LINE), (before == _SPACE) | (before == _LINE)
    letter = kind == _LETTER

    # where a sentence begins
    last = np.maximum.accumulate(np.where((kind != _CLOSE) & ~blank, at, 0))  # the last character that is no blank or closing mark
    gap = np.flatnonzero(blank & ~blank_before)
    begin = np.flatnonzero(~blank & blank_before)  # of tokens
    follow = begin[np.minimum(np.searchsorted(begin, gap), len(begin) - 1)] if len(begin) else gap
    stop = last[np.maximum(gap - 1, 0)]
    single = (c[stop] == ord(".")) & letter[np.maximum(stop - 1, 0)] & (blank[np.maximum(stop - 2, 0)] | (stop < 2))  # an initial
    breaks = kind == _LINE
    breaks[gap[(kind[stop] == _END) & ~single & (kind[follow] != _DIGIT)]] = True
    breaks |= (kind == _OPEN) & (before == _END)
    breaks |= ((kind == _BAR) | (c == ord("|"))) & blank_before & ((after == _SPACE) | (after == _LINE))
    number = np.cumsum(breaks)

    # words, without those in tokens that have marks of code
    starts = np.flatnonzero(letter & (before != _LETTER))
    ends = np.flatnonzero(letter & (after != _LETTER)) + 1
    code = (kind == _CODE) & ~((before == _SPACE) & (after == _SPACE))
    colon = c == ord(":")
    code[1:] |= colon[1:] & (c[:-1] == ord('"'))
    code[:-1] |= colon[:-1] & (c[1:] == ord("/"))
    token = np.cumsum(~blank & blank_before) - 1
    coded = np.zeros(len(begin) + 1, dtype=bool)
    coded[token[code & ~blank]] = True
    where_from = starts if place is None else place[starts]
    per_text = np.bincount(np.searchsorted(first, where_from, "right") - 1, minlength=len(texts))
    keep = ~coded[token[starts]] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[keep], ends[keep]

    # different words
    long = ends - starts
    inner = np.repeat(starts, long) + np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
    step = inner - np.repeat(starts, long)
    power = np.cumprod(np.concatenate(([1], np.full(int(long.max(initial=1)), 0xD1342543DE82EF95, dtype=np.uint64))).astype(np.uint64))
    h = np.add.reduceat(_mix(lower[c[inner]].astype(np.uint64) + np.uint64(1)) * power[step], np.cumsum(long) - long) if len(starts) else np.zeros(0, np.uint64)
    hashes, one, which = np.unique(h, return_index=True, return_inverse=True)
    bins, owner = _features(c, starts[one], ends[one], lower, bare)

    # sentences
    _, s_first, sentence = np.unique(number[starts], return_index=True, return_inverse=True)
    s_end = np.append(s_first, len(starts))[1:]
    letters = np.add.reduceat(long, s_first) if len(s_first) else np.zeros(0, np.int64)
    lo, hi = starts[s_first], ends[s_end - 1] - 1
    if place is not None:
        lo, hi = place[lo], place[hi]
    text = np.searchsorted(first, lo, "right") - 1
    lo, hi = lo - first[text], hi - first[text]
    for k, origin in fixed.items():
        mine = slice(*np.searchsorted(text, [k, k + 1]))
        lo[mine], hi[mine] = origin[lo[mine]], origin[hi[mine]]
    weight = np.where(capital[c[starts]], np.float32(NAME_WEIGHT), np.float32(1))
    return Words(sentence, which, weight, text, lo, hi + 1, letters, bins, owner, hashes, per_text)


def _features(c: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: np.ndarray, bare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bins, word) of the n-grams of each word with its borders and of the word as a whole, once with accents removed
    and, where it has any, once with them."""
    long = ends - starts
    inner = np.repeat(starts, long) + np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
    owner = np.repeat(np.arange(len(starts)), long)
    low, plain = lower[c[inner]], bare[c[inner]]
    accented = np.zeros(len(starts), dtype=bool)
    accented[owner[low != plain]] = True
    also = accented[owner]
    all_bins, owners = [], []
    for chars, word, size in ((plain, owner, long), (low[also], owner[also], long[accented])):
        if not len(chars):
            continue
        # a row of the words, each between two borders and a gap
        ids = np.flatnonzero(accented) if chars is not plain else np.arange(len(starts))
        head = np.cumsum(size + 3) - (size + 3)
        row = np.zeros(int((size + 3).sum()), dtype=np.uint64)
        row[head], row[head + size + 1] = 32, 32
        row[np.repeat(head + 1, size) + np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size)] = chars
        mine = np.repeat(ids, size + 3)
        gap = row == 0
        for m in SIZES:
            if len(row) < m:
                continue
            h = np.full(len(row) - m + 1, m * 0x9E3779B1, dtype=np.uint64)
            ok = np.ones(len(h), dtype=bool)
            for k in range(m):
                h = _mix(h ^ row[k : k + len(h)])
                ok &= ~gap[k : k + len(h)]
            all_bins.append(((h >> np.uint64(40)) % np.uint64(BINS)).astype(np.int32)[ok])
            owners.append(mine[: len(h)][ok])
        step = np.arange(len(chars)) - np.repeat(np.cumsum(size) - size, size)
        power = np.cumprod(np.concatenate(([7], np.full(int(size.max()), 0x9FB21C651E98DF25, dtype=np.uint64))).astype(np.uint64))
        h = np.add.reduceat(_mix(chars.astype(np.uint64) + np.uint64(1)) * power[step], np.cumsum(size) - size)
        all_bins.append(((_mix(h) >> np.uint64(40)) % np.uint64(BINS)).astype(np.int32))
        owners.append(ids)
    if not all_bins:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    b, o = np.concatenate(all_bins), np.concatenate(owners)
    order = np.argsort(o, kind="stable")
    return b[order], o[order]


def _sums(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by group; groups rise."""
    out = np.zeros((n, *values.shape[1:]), dtype=np.float32)
    if len(group):
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        out[group[first]] = np.add.reduceat(values, first, axis=0)
    return out


# --- codewords and classifiers -----------------------------------------------------------------------------------


@lru_cache(16)
def codewords(n: int, bits: int | None = None, seed: int = 7) -> np.ndarray:
    """n x bits of +-1: balanced columns, different where there are enough, with the largest smallest distance found."""
    bits = bits or max(15, 3 * n.bit_length() + 3)
    if n < 2:
        return np.ones((n, bits), dtype=np.float32)
    rng = np.random.default_rng(seed)
    best, far = None, -1
    for _ in range(2000 if n <= 12 else 300):
        cols, tries = [], 0
        while len(cols) < bits:
            ones = rng.permutation(n) < n // 2
            col = tuple(ones if ones[0] else ~ones)  # a column and its complement say the same
            tries += 1
            if col not in cols or tries > 4 * bits:
                cols.append(col)
        code = np.array(sorted(cols)).T * 2 - 1
        apart = bits - int(((code @ code.T) - 2 * bits * np.eye(n, dtype=int)).max() + bits) // 2
        if apart > far:
            best, far = code, apart
    return best.astype(np.float32)


@dataclass
class Model:
    """langs: codes of the languages; weights: bins x bits log-odds; bit_weight: reliability of each bit; code: codewords."""

    langs: list[str]
    weights: np.ndarray
    bit_weight: np.ndarray
    code: np.ndarray

    def margins(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """Sentences x bits, and the number of features that each sentence has."""
        vector = _sums(self.weights[w.bins], w.owner, w.n_kinds)
        many = np.bincount(w.owner, minlength=w.n_kinds).astype(np.float32)
        size = _sums(many[w.kind] * w.weight, w.sentence, len(w.text))
        total = _sums(vector[w.kind] * w.weight[:, None], w.sentence, len(w.text))
        return total / np.sqrt(np.maximum(size, 1))[:, None], size

    def losses(self, w: Words) -> np.ndarray:
        """Sentences x languages and, last, OTHER. A sentence's losses shrink with what it says."""
        z, size = self.margins(w)
        out = np.full((len(z), len(self.langs) + 1), FAR, dtype=np.float32)
        if self.langs:
            share = self.bit_weight / float(self.bit_weight.sum())
            right, wrong = np.logaddexp(0, -z) * share, np.logaddexp(0, z) * share
            out[:, :-1] = right @ (self.code.T > 0) + wrong @ (self.code.T < 0)
        return out * (size / (size + EVIDENCE))[:, None]

    def decode(self, texts: list[str]) -> list[tuple[str | None, float]]:
        """(language, confidence) of each text as a whole; a text without letters has none."""
        w = words(texts)
        loss = _sums(self.losses(w), w.text, len(texts))
        sure = confidence(loss).max(1)
        there = np.bincount(w.text, minlength=len(texts)) > 0
        best = loss[:, :-1].argmin(1) if self.langs else np.zeros(len(texts), np.int64)
        far = (loss[np.arange(len(texts)), best] > loss[:, -1]) & (loss[:, -1] >= FAR * LEAST_SAID)
        return [(OTHER if f or not self.langs else self.langs[k], float(s)) if ok else (None, 0.0) for k, f, s, ok in zip(best, far, sure, there)]


def confidence(loss: np.ndarray) -> np.ndarray:
    p = np.exp(-(loss - loss.min(1, keepdims=True)) * 4)
    return p / p.sum(1, keepdims=True)


def fit_words(w: Words, labels: np.ndarray, langs: list[str], rounds: int = 2) -> Model:
    """Fit the bits' classifiers to sentences with (partly wrong) language numbers.

    The n-gram shares of the languages on either side of a bit give its log-odds; an n-gram that both sides share says
    nothing. After each of the `rounds` the sentences take the languages that their texts' cheapest paths give them.
    """
    code = codewords(len(langs))
    n, bits = code.shape
    model = Model(langs, np.zeros((BINS, bits), dtype=np.float32), np.ones(bits, dtype=np.float32), code)
    if not len(labels) or not n:
        return model
    up = (code > 0).astype(float).T
    for again in range(rounds + 1):
        seen = np.bincount(labels[w.sentence] * w.n_kinds + w.kind, w.weight, n * w.n_kinds).reshape(n, w.n_kinds)
        count = np.stack([np.bincount(w.bins, row[w.owner], BINS) for row in seen])
        share = count / np.maximum(1, count.sum(1, keepdims=True))
        common = share.mean(0) * 0.1 + 1e-9
        plus, minus = ((side @ share) / np.maximum(1, side.sum(1))[:, None] + common for side in (up, 1 - up))
        model.weights = (np.where(count.sum(0) > 0, np.log(plus) - np.log(minus), 0).T * 0.5).astype(np.float32)
        if again == rounds:
            break
        right = np.clip((model.margins(w)[0] * code[labels] > 0).mean(0), 0.55, 0.999)
        model.bit_weight = np.log(right / (1 - right)).astype(np.float32)
        labels = paths(model.losses(w)[:, :-1], w.text)
    return model


def fit_texts(texts: list[str], labels: list[str], most_sentences: int = SAMPLE_SENTENCES, per_language: int = PER_LANGUAGE) -> Model:
    """Fit on texts with (partly wrong) language codes: of each text that many sentences evenly spread over it, of each
    language that many sentences. A language that fewer than `LEAST_DOCS` texts are labelled with gets no codeword.
    """
    name, many = np.unique(np.array(labels, dtype=str), return_counts=True)
    langs = [str(x) for x in name[many >= LEAST_DOCS]]
    number = {x: k for k, x in enumerate(langs)}
    kept = [(t, number[x]) for t, x in zip(texts, labels) if x in number]
    parts, held, size = [], [], 0
    for k, (text, _) in enumerate(kept):
        held.append(text)
        size += len(text)
        if size >= PIECE or k == len(kept) - 1:
            w = words(held)
            n = np.bincount(w.text, minlength=1)[w.text]
            parts.append(w.only((np.arange(len(w.text)) - np.searchsorted(w.text, w.text)) % -(-n // most_sentences) == 0))
            held, size = [], 0
    w = Words.joined(parts) if parts else words([])
    of = np.array([k for _, k in kept], dtype=np.int64)[w.text]
    rng = np.random.default_rng(3)
    chosen = np.zeros(len(w.text), dtype=bool)
    for k in range(len(langs)):
        chosen[rng.permutation(np.flatnonzero(of == k))[:per_language]] = True
    return fit_words(w.only(chosen), of[chosen], langs)


def fit(documents: DataFrame, text: str = "text", label: str = "lang", doc_id: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit on about `sample_docs` documents with a label that names a language, chosen by the hash of id and text, of each
    its first `SAMPLE_CHARS` characters. So at most about 32 million characters come to the driver.
    """
    require_columns(documents, text, label, doc_id)
    rows = documents.select(F.col(text).alias("text"), label_language(F.col(label)).alias("lang"), F.xxhash64(doc_id, text).alias("h")).filter("lang is not null and text is not null")
    every = max(1, -(-rows.count() // sample_docs))
    got = rows.filter(F.pmod("h", F.lit(every)) == 0).select(F.substring("text", 1, SAMPLE_CHARS).alias("text"), "lang", "h").toArrow().sort_by("h")
    return fit_texts(got.column("text").to_pylist(), got.column("lang").to_pylist())


# --- documents -----------------------------------------------------------------------------------------------------


def paths(loss: np.ndarray, text: np.ndarray) -> np.ndarray:
    """The language of each sentence that makes its text's losses and changes cheapest in sum.

    Neighbours with the same best language never differ on the cheapest path, so they are taken together; the texts'
    remaining steps are walked side by side.
    """
    best = loss.argmin(1)
    if not len(best):
        return best
    new = np.concatenate(([True], (best[1:] != best[:-1]) | (text[1:] != text[:-1])))
    run = np.cumsum(new) - 1
    owner = text[new]
    _, first, n = np.unique(owner, return_index=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    first, n = first[order], n[order]
    many = n > 1
    first, n = first[many], n[many]
    found = best[new]
    if len(n):
        cost = np.add.reduceat(loss, np.flatnonzero(new), axis=0).astype(np.float64)
        states = np.arange(cost.shape[1])
        back = np.zeros(cost.shape, dtype=np.int16)
        sums = cost[first].copy()
        for t in range(1, int(n[0])):
            m = int(np.searchsorted(-n, -t, "left"))  # texts with more than t runs
            low = sums[:m].argmin(1)
            jump = sums[np.arange(m), low] + CHANGE
            stay = sums[:m] <= jump[:, None]
            back[first[:m] + t] = np.where(stay, states, low[:, None])
            sums[:m] = np.minimum(sums[:m], jump[:, None]) + cost[first[:m] + t]
        now = sums.argmin(1)
        found[first + n - 1] = now
        for t in range(int(n[0]) - 1, 0, -1):
            m = int(np.searchsorted(-n, -t, "left"))
            found[first[:m] + t - 1] = back[first[:m] + t, found[first[:m] + t]]
    return found[run]


@dataclass
class _Read:
    """Sentences of a batch of rows: row, start, end, letters, loss by language; and n_words of each row."""

    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    loss: np.ndarray
    n_words: np.ndarray


def _read(texts: list[str], model: Model) -> _Read:
    parts: list[tuple] = []
    n_words = np.zeros(len(texts), dtype=np.int64)
    held: list[tuple[int, int, str]] = []
    size = 0

    def flush() -> None:
        row = np.array([h[0] for h in held])
        w = words([h[2] for h in held])
        np.add.at(n_words, row, w.n_words)
        off = np.array([h[1] for h in held])[w.text]
        parts.append((row[w.text], w.start + off, w.end + off, w.letters, model.losses(w)))
        held.clear()

    for k, text in enumerate(texts):
        for at, piece in pieces(text):
            held.append((k, at, piece))
            size += len(piece) + 20
            if size >= PIECE:
                flush()
                size = 0
    if held:
        flush()
    if not parts:
        none = np.zeros(0, dtype=np.int64)
        return _Read(none, none, none, none, np.zeros((0, len(model.langs) + 1), np.float32), n_words)
    return _Read(*(np.concatenate([p[c] for p in parts]) for c in range(5)), n_words)


@dataclass
class _Stretches:
    """Of each stretch: row, language number, confidence, ambiguous, start, end, n_sentences, letters."""

    row: np.ndarray
    lang: np.ndarray
    sure: np.ndarray
    vague: np.ndarray
    start: np.ndarray
    end: np.ndarray
    n: np.ndarray
    letters: np.ndarray


def _stretches(r: _Read) -> _Stretches:
    n, known = len(r.row), r.loss.shape[1] - 1
    path = paths(r.loss[:, :-1], r.row) if known else np.zeros(n, dtype=np.int64)
    # beyond the limit, with enough said: in none of the languages
    far = (r.loss[np.arange(n), path] > r.loss[:, -1]) & (r.loss[:, -1] >= FAR * LEAST_SAID)
    path = np.where(far, known, path)
    head = np.flatnonzero(np.concatenate(([True], (path[1:] != path[:-1]) | (r.row[1:] != r.row[:-1])))) if n else np.zeros(0, np.int64)
    many = np.diff(np.append(head, n))
    tail = head + many - 1
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return _Stretches(none, none, none.astype(float), none.astype(bool), none, none, none, none)
    own = confidence(r.loss)[np.arange(n), path] * r.letters
    letters = np.add.reduceat(r.letters, head)
    total = np.add.reduceat(r.loss, head, axis=0)
    each = np.arange(len(head))
    lang = path[head]
    mine = total[each, lang].copy()
    total[each, lang] = np.inf
    total[:, -1] = np.inf
    vague = (total.min(1) - mine < LEAST_LEAD) & (lang < known)
    return _Stretches(r.row[head], lang, np.add.reduceat(own, head) / letters, vague, r.start[head], r.end[tail], many, letters)


def _run(model: Model, spark, summarise, n_keep: int, names: list[str]):
    shared = spark.sparkContext.broadcast((model.langs, model.weights, model.bit_weight, model.code))  # 4 MB at ten languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 5000):
                batch = whole.slice(at, 5000)
                texts = [x or "" for x in batch.column(0).to_pylist()]
                idx, columns = summarise(_read(texts, m), m, len(texts))
                kept = [batch.column(c + 1) if idx is None else batch.column(c + 1).take(idx) for c in range(n_keep)]
                yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*batch.schema.names[1:], *names])

    return run


_SEGMENTS = "n_words int, segment int, lang string, confidence double, ambiguous boolean, start bigint, end bigint, n_sentences int, n_letters bigint"
_DOCUMENT = "n_words int, lang string, confidence double, langs array<string>"


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def _as_segments(r: _Read, m: Model, n: int):
    s = _stretches(r)
    silent = np.setdiff1d(np.arange(n), s.row)
    row = np.concatenate([s.row, silent]).astype(np.int64)
    order = np.argsort(row, kind="stable")
    first = np.searchsorted(s.row, s.row)
    fill = lambda x, v: np.concatenate([x, np.full(len(silent), v, dtype=x.dtype)])[order]
    place = fill(np.arange(len(s.row)) - first, 0)
    names = pa.array([*m.langs, OTHER])
    lang = names.take(pa.array(fill(s.lang.astype(np.int64), 0), mask=fill(np.zeros(len(s.row), bool), True)))
    return pa.array(row[order]), [
        pa.array(r.n_words[row[order]].astype(np.int32)), pa.array(place.astype(np.int32)), lang, pa.array(fill(s.sure, 0.0)), pa.array(fill(s.vague, False)),
        pa.array(fill(s.start, 0)), pa.array(fill(s.end, 0)), pa.array(fill(s.n, 0).astype(np.int32)), pa.array(fill(s.letters, 0)),
    ]


def _as_documents(r: _Read, m: Model, n: int):
    s = _stretches(r)
    k = len(m.langs) + 1
    letters = np.zeros((n, k), dtype=np.int64)
    np.add.at(letters, (s.row, s.lang), s.letters)
    sure = np.zeros((n, k))
    np.add.at(sure, (s.row, s.lang), s.sure * s.letters)
    clear = np.zeros((n, k), dtype=bool)
    clear[s.row[~s.vague], s.lang[~s.vague]] = True
    clear[clear[:, :-1].any(1), -1] = False  # what is in no known language may be names or code, beside what is
    main = letters.argmax(1)
    most = letters[np.arange(n), main]
    vague = ~clear.any(1) & (most > 0)
    clear[vague, main[vague]] = True
    row, lang = np.nonzero(clear)
    names = pa.array([*m.langs, OTHER])
    langs = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32)), names.take(pa.array(lang)))
    one = names.take(pa.array(main, mask=most == 0))
    return None, [pa.array(r.n_words.astype(np.int32)), one, pa.array(sure[np.arange(n), main] / np.maximum(1, most)), langs]


def _decoded(documents: DataFrame, model: Model, text: str, keep: list[Column], summarise, schema: str) -> DataFrame:
    rows = documents.select(F.col(text).alias("_text_in"), *keep)
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[1:])
    return rows.mapInArrow(_run(model, documents.sparkSession, summarise, len(keep), _names(schema)), f"{kinds}, {schema}")


def segments(documents: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, `keep` columns, n_words, then one row per stretch of consecutive sentences in one language.

    segment counts from 0; start and end are the places of the stretch's first letter and after its last in the text
    as given; confidence is the mean over the stretch's letters; a stretch whose language leads the next by little is
    ambiguous. `OTHER` is the language of what is near no language of the labels. A document without a letter outside
    of code, be it null, empty or blank, has one row with segment 0, null lang and confidence 0. Null and repeated
    doc_ids are kept, one set of rows a row; an empty table gives no rows; other columns are ignored.
    """
    require_columns(documents, text, doc_id, *keep)
    return _decoded(documents, model, text, [F.col(c) for c in (doc_id, *keep)], _as_segments, _SEGMENTS)


def document_languages(documents: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", label: str = "lang") -> DataFrame:
    """One row per row of the table: doc_id, label (as code, or null), lang with most letters, confidence, n_langs, mixed.

    n_langs counts the languages of clear stretches, or is 1 where no stretch is clear; a text without letters has a
    null lang, confidence 0 and n_langs 0.
    """
    require_columns(documents, text, doc_id, label)
    d = _decoded(documents, model, text, [F.col(doc_id).alias("doc_id"), label_language(F.col(label)).alias("label")], _as_documents, _DOCUMENT)
    return d.select("doc_id", "label", "lang", "confidence", F.size("langs").alias("n_langs"), (F.size("langs") > 1).alias("mixed"))


def label_errors(documents: DataFrame, model: Model, text: str = "text", doc_id: str = "doc_id", label: str = "lang", least_words: int = 5) -> DataFrame:
    """doc_id and lang, one row for each language in which a document has a clear stretch, of documents with at least
    `least_words` words whose label is missing, names no language or another one than the text's, or whose text has
    clear stretches in several languages. A text without a clear stretch counts as one in its likeliest language.
    Rows of one doc_id and lang come out once; an empty table gives none.
    """
    require_columns(documents, text, doc_id, label)
    d = _decoded(documents, model, text, [F.col(doc_id).alias("doc_id"), label_language(F.col(label)).alias("label")], _as_documents, _DOCUMENT)
    wrong = F.col("label").isNull() | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("label"))
    return d.filter((F.col("n_words") >= least_words) & F.coalesce(wrong, F.lit(True))).select("doc_id", F.explode("langs").alias("lang")).distinct()
