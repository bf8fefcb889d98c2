r"""Passages of test items in a corpus, found by counting shared character q-grams in diagonal bands.

The rule: a text leaks an item if it holds ``WORDS`` successive words of it, first and last among them, of which at most
``BUDGET`` are altered (another word in place, a word missing, a word too many); a word written with small alterations of
spelling (``alike``) counts as the word itself, however many of them there are. Wording of ``WORDS`` and more words that
several items share counts for none of them.

The search loses no text that the rule accepts, so neither the order nor the number of items changes what is found:

1. Texts and items are reduced to bare words (no case, accents, signs, markup or look-alike letters). Words of the text are
   compared with those of the items by the q-gram lemma: with e slips allowed, two words of which the longer has L letters share
   at least L + Q - 1 - e (Q + 1) of their padded q-grams. Each distinct word is looked up once a worker.
2. Of every item passage the ``RAREST`` rarest words are kept at least, weighed by the q-grams that any admissible spelling still
   shares. A passage with its budget spent keeps the sum of these weights less the ``BUDGET`` largest; regions of an
   item's diagonal band (in words; bands overlap, so a passage with its shifts lies within one) that reach the least such sum are retained.
3. A banded alignment of words verifies the rule itself.

The items go to the executors in blocks of bounded size; a text is cut into words once and held against all blocks, so neither
the items nor the texts are joined by pairs, and no text is shuffled.

Defined cases: NULL and empty texts hold nothing; texts of any length are read whole; repeated rows and items are
reported each, distinct; rows or items without an id are left out; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.lookalike import INVISIBLE, TO_LATIN, Table, _one

#: Successive words that make a case, and how many of them may be altered.
WORDS, BUDGET = 12, 2
#: Length of q-grams; least number of kept words of each passage (more than BUDGET, so some are always left).
Q, RAREST = 3, 7
#: Words of the text that a passage spans at most, less one; width of a diagonal band and the step from one to the next.
REACH, BAND, STEP = WORDS + BUDGET - 1, 2 * BUDGET, BUDGET
#: Characters of item text that one block may have, and of texts that are searched at a time.
BLOCK, CHUNK = 4_000_000, 2_000_000
#: Distinct words whose spellings a worker keeps.
KNOWN = 300_000

MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,200}>|\[\.\.\.\]")
WORD = re.compile(r"[^\W_]+")


def _bare(c: str) -> str | None:
    if c in INVISIBLE:
        return None
    return "".join(TO_LATIN.get(x, x) for x in unicodedata.normalize("NFKD", _one(c)) if not unicodedata.combining(x))


BARE = Table(_bare)


def words(text: str) -> list[str]:
    """The bare words of a text."""
    if "<" in text or "[" in text:
        text = MARKUP.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = text.translate(BARE)
    return WORD.findall(text.casefold())


def _slips(length: int) -> int:
    """Slips of spelling allowed between two words of which the longer has so many letters."""
    return max(1, length // 4)


def alike(a: str, b: str) -> bool:
    """Whether two words are the same or differ by small alterations of spelling (letters changed, missing, added or swapped)."""
    if a == b:
        return True
    if a.isdigit() or b.isdigit():
        return False
    most = _slips(max(len(a), len(b)))
    if min(len(a), len(b)) < 3 or abs(len(a) - len(b)) > most:
        return False
    # equal ends cost nothing
    n = min(len(a), len(b))
    i = next((k for k in range(n) if a[k] != b[k]), n)
    n -= i
    j = next((k for k in range(n) if a[-1 - k] != b[-1 - k]), n)
    a, b = a[i : len(a) - j], b[i : len(b) - j]
    if max(len(a), len(b)) <= 1 or not a or not b:
        return max(len(a), len(b)) <= most
    if most == 1:
        return len(a) == len(b) == 2 and a == b[::-1]
    last2, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            c = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if last2 is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                c = min(c, last2[j - 2] + 1)
            row.append(c)
        if min(row) > most:
            return False
        last2, last = last, row
    return last[-1] <= most


def _shared_grams(length: int) -> int:
    """The q-grams that two words alike share at least, the longer of so many letters (the q-gram lemma; a swap spoils Q + 1)."""
    return length + Q - 1 - (Q + 1) * _slips(length)


def _weight(word: str) -> int:
    """The q-grams that every admissible spelling of a word shares with it."""
    n = len(word)
    if n < 3 or word.isdigit():
        return n + Q - 1
    return max(1, min(_shared_grams(m) for m in range(n, n + 1 + _slips(n + _slips(n)))))


def _padded_grams(word: str) -> list[str]:
    s = "\0" * (Q - 1) + word + "\0" * (Q - 1)
    return [s[i : i + Q] for i in range(len(word) + Q - 1)]


class Spellings:
    """Which words of a vocabulary are alike to a given one: candidates by counts of shared q-grams, verified letter by letter."""

    def __init__(self, vocabulary: list[str]):
        self.words, self.number = vocabulary, {w: k for k, w in enumerate(vocabulary)}
        self.lengths = np.array([len(w) for w in vocabulary], np.int64)
        # what can be misspelled at all; a q-gram met n times in a word is n different ones
        rows: dict[tuple[str, int], list[int]] = {}
        for k, w in enumerate(vocabulary):
            if len(w) >= 3 and not w.isdigit():
                seen: Counter = Counter()
                for g in _padded_grams(w):
                    rows.setdefault((g, seen[g]), []).append(k)
                    seen[g] += 1
        self.rows = {g: np.array(r, np.int64) for g, r in rows.items()}
        self.letters = np.zeros((len(vocabulary), 32), np.int16)
        for k, w in enumerate(vocabulary):
            np.add.at(self.letters[k], self._hashed(w), 1)

    @staticmethod
    def _hashed(word: str) -> np.ndarray:
        return np.frombuffer(word.encode("utf-32-le"), np.uint32) % 32

    def of(self, word: str) -> list[int]:
        """The numbers of the words alike to ``word``, itself among them."""
        k = self.number.get(word)
        found = [] if k is None else [k]
        n = len(word)
        if n < 3 or word.isdigit() or not self.words:
            return found
        seen: Counter = Counter()
        posts = []
        for g in _padded_grams(word):
            if (r := self.rows.get((g, seen[g]))) is not None:
                posts.append(r)
            seen[g] += 1
        if not posts:
            return found
        counts = np.bincount(np.concatenate(posts), minlength=1)
        at = np.flatnonzero(counts)
        count = counts[at]
        longer = np.maximum(self.lengths[at], n)
        slips = np.maximum(1, longer // 4)
        at, slips = (x[(np.abs(self.lengths[at] - n) <= slips) & (count >= np.maximum(1, longer + Q - 1 - (Q + 1) * slips))] for x in (at, slips))
        if not len(at):
            return found
        diff = self.letters[at] - np.bincount(self._hashed(word), minlength=32)
        apart = np.maximum(np.where(diff > 0, diff, 0).sum(1), np.where(diff < 0, -diff, 0).sum(1))  # slips at least
        return found + [int(v) for v in at[apart <= slips] if v != k and alike(word, self.words[v])]


class Items:
    """The index of a block of items: its vocabulary and where the kept words of each item stand.

    ``shared``: of each item the words within wording that another item has too.
    """

    def __init__(self, ids: list[int], texts: list[str], shared: list[set[int]]):
        self.ids = ids
        cut = [words(t) for t in texts]
        self.vocabulary = sorted({w for c in cut for w in c})
        self.spellings = Spellings(self.vocabulary)
        self.numbers = [[self.spellings.number[w] for w in c] for c in cut]
        self.own = [[i not in s for i in range(len(c))] for c, s in zip(cut, shared)]
        often = np.bincount(
            np.concatenate([*map(np.array, filter(None, self.numbers)), np.zeros(0, np.int64)]).astype(np.int64), minlength=len(self.vocabulary)
        )
        weight = np.array([_weight(w) for w in self.vocabulary], np.int64)
        at, place, least = [], [], np.zeros(len(ids), np.int64)
        for k, nums in enumerate(self.numbers):
            if len(nums) < WORDS:
                continue
            v = np.array(nums)
            window = np.lib.stride_tricks.sliding_window_view
            whole = np.flatnonzero(window(np.array(self.own[k]), WORDS).all(1))
            if not len(whole):
                continue
            rank = np.argsort(window(often[v], WORDS)[whole], axis=1, kind="stable")[:, :RAREST]
            keep = np.unique(whole[:, None] + rank)
            w = np.zeros(len(v), np.int64)
            w[keep] = weight[v[keep]]
            sums = window(w, WORDS)[whole]
            least[k] = (sums.sum(1) - np.sort(sums, axis=1)[:, -BUDGET:].sum(1)).min()
            at.append(np.full(len(keep), k))
            place.append(keep)
        empty = np.zeros(0, np.int64)
        self.least = least
        item, place = (np.concatenate([*x, empty]) for x in (at, place))
        word = np.array([self.numbers[k][i] for k, i in zip(item, place)], np.int64)
        order = np.argsort(word, kind="stable")
        self.item, self.place, self.weight = item[order], place[order], weight[word[order]] if len(word) else empty
        self.first = np.searchsorted(word[order], np.arange(len(self.vocabulary) + 1))
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[str, int] = {}  # word of a text -> its number here
        self.alike: list[frozenset[int]] = []
        self.hits: list[np.ndarray] = []
        self.flat = (0, np.zeros(1, np.int64), np.zeros(0, np.int64))

    def _number(self, flat: list[str]) -> np.ndarray:
        """The words of texts as numbers; new ones are compared with the vocabulary."""
        if len(self.seen) > KNOWN:
            self._forget()
        for w in set(flat).difference(self.seen):
            self.seen[w] = len(self.alike)
            same = self.spellings.of(w)
            self.alike.append(frozenset(same))
            self.hits.append(np.concatenate([np.arange(self.first[v], self.first[v + 1]) for v in same]) if same else np.zeros(0, np.int64))
        if self.flat[0] != len(self.hits):
            self.flat = (len(self.hits), np.cumsum([0, *map(len, self.hits)]), np.concatenate([np.zeros(0, np.int64), *self.hits]))
            self.best = np.array([self.weight[h].max() if len(h) else 0 for h in self.hits], np.int64)
        return np.fromiter(map(self.seen.__getitem__, flat), np.int64, len(flat))

    def search(self, texts: list[list[str]]) -> list[tuple[int, int]]:
        """(item id, number of the text) of the texts, cut into words, that hold passages of items."""
        if not len(self.item):
            return []
        sizes = np.array([len(t) for t in texts], np.int64)
        numbers = self._number([w for t in texts for w in t])
        text = np.repeat(np.arange(len(texts)), sizes)
        begin = np.cumsum(sizes) - sizes
        inside = np.arange(len(numbers)) - begin[text]
        _, first, all_hits = self.flat
        n = first[numbers + 1] - first[numbers]
        at = self._dense(np.flatnonzero(n), numbers, text)
        if not len(at):
            return []
        n = n[at]
        at, start = np.repeat(at, n), np.repeat(first[numbers[at]], n)
        hit = all_hits[np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + start]
        item, diagonal = self.item[hit], self.place[hit] - inside[at]
        found: set[tuple[int, int]] = set()
        low = int(inside.max()) + 1
        for half in (0, 1):  # bands of BAND diagonals, STEP apart: each half holds every other one
            band = (diagonal + low + half * STEP) // BAND
            # words come in order, so a stable sort by item and band leaves texts and places in order within each
            order = np.argsort(item * (int(band.max()) + 1) + band, kind="stable")
            t, i, b, d, w = text[at][order], item[order], band[order], at[order], self.weight[hit][order]
            new = np.r_[True, (t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])]
            other = new | np.r_[True, d[1:] != d[:-1]]
            start = np.flatnonzero(other)
            best = np.maximum.reduceat(w, start)  # a word of the text counts once
            group, d1 = (np.cumsum(new) - 1)[start], d[start]
            total = np.cumsum(np.r_[0, best])
            key = group * (len(numbers) + REACH + 2) + d1
            back = np.searchsorted(key, np.maximum(key - REACH, group * (len(numbers) + REACH + 2)))
            enough = np.flatnonzero(total[1:] - total[back] >= self.least[i[start]])
            if not len(enough):
                continue
            # regions that overlap make one
            apart = np.flatnonzero(np.r_[True, (group[enough[1:]] != group[enough[:-1]]) | (d1[back[enough[1:]]] > d1[enough[:-1]] + REACH)])
            for u, v in zip(apart, np.r_[apart[1:], len(enough)]):
                lo, hi, g = d1[back[enough[u]]], d1[enough[v - 1]], start[enough[u]]
                k, which = int(i[g]), int(t[g])
                if (self.ids[k], which) in found:
                    continue
                a, e = max(int(lo - begin[which]) - REACH, 0), min(int(hi - begin[which]) + REACH + 1, int(sizes[which]))
                from_ = int(b[g]) * BAND - low - half * STEP
                if self._aligned(k, [self.alike[x] for x in numbers[begin[which] + a : begin[which] + e]], a + from_):
                    found.add((self.ids[k], which))
        return sorted(found)

    def _dense(self, at: np.ndarray, numbers: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Those places of kept words about which enough of them stand for any item."""
        if not len(at):
            return at
        total = np.cumsum(np.r_[0, self.best[numbers[at]]])
        shifted = at + text[at] * (REACH + 1)  # no reach across texts
        last = np.searchsorted(shifted, shifted + REACH, "right")
        full = total[last] - total[:-1] >= self.least[self.least > 0].min()
        marks = np.zeros(len(at) + 1, np.int64)
        np.add.at(marks, np.flatnonzero(full), 1)
        np.add.at(marks, last[full], -1)
        return at[np.cumsum(marks[:-1]) > 0]

    def _aligned(self, k: int, text: list[frozenset[int]], shift: int) -> bool:
        """Whether the rule holds on the diagonals shift to shift + BAND - 1 of an item and a stretch of a text.

        For each place (i, j) and number of altered words the longest passage of own words that ends there.
        """
        item, own = self.numbers[k], self.own[k]
        # at least so many words of the stretch that a passage spans must be alike to one of the item's on these diagonals
        met = [0]
        for j, same in enumerate(text):
            met.append(met[-1] + (bool(same) and not same.isdisjoint(item[max(0, j + shift) : max(0, j + shift + BAND)])))
        if all(b - a < WORDS - BUDGET for a, b in zip(met, met[min(REACH + 1, len(text)) :])):
            return False
        none = (0,) * (BUDGET + 1)
        last: dict[int, tuple[int, ...]] = {}
        for j, same in enumerate(text):
            now: dict[int, tuple[int, ...]] = {}
            for i in range(max(0, j + shift), min(len(item), j + shift + BAND)):
                if not own[i]:
                    continue
                p, left, up = last.get(i - 1, none), last.get(i, none), now.get(i - 1, none)
                fits = item[i] in same
                row = [p[0] + 1 if fits else 0]
                for c in range(1, BUDGET + 1):
                    best = max(left[c - 1], up[c - 1] + 1 if up[c - 1] else 0, p[c - 1] + 1 if p[c - 1] else 0)
                    row.append(max(best, p[c] + 1 if fits else 0))
                if fits and p[BUDGET] + 1 >= WORDS:
                    return True
                if row[BUDGET]:
                    now[i] = tuple(row)
            last = now
        return False


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(i, t, text, at, window): the hashed passages of WORDS words of each item."""
    for b in batches:
        for key, text in zip(b["i"], b["t"]):
            w = words(text)
            digest = int.from_bytes(hashlib.blake2b(" ".join(w).encode(), digest_size=8).digest(), "little", signed=True)
            rows = [(key, text, digest, k, hashlib.blake2b(" ".join(w[k : k + WORDS]).encode(), digest_size=16).hexdigest()) for k in range(len(w) - WORDS + 1)]
            yield pd.DataFrame(rows, columns=["i", "t", "digest", "at", "window"])


def shared_words(items: DataFrame) -> DataFrame:
    """(i, t, starts): the items (i, t) that have passages of WORDS words in common with an item of other wording, and where those begin."""
    each = items.mapInPandas(_windows, "i long, t string, digest long, at int, window string")
    common = each.groupBy("window").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("window")
    return each.select(F.col("i"), F.md5("t").alias("t"), "at", "window").join(common, "window").groupBy("i", "t").agg(F.collect_list("at").alias("starts"))


def _blocks(rows: list[tuple[int, str, set[int]]]) -> Iterator[tuple[list[int], list[str], list[set[int]]]]:
    """The items in blocks of at most BLOCK characters (an item longer than that is a block of its own)."""
    part: tuple[list, list, list] = ([], [], [])
    size = 0
    for row in rows:
        if part[0] and size + len(row[1]) > BLOCK:
            yield part
            part, size = ([], [], []), 0
        for x, y in zip(part, row):
            x.append(y)
        size += len(row[1])
    if part[0]:
        yield part


@lru_cache(maxsize=64)
def _index(block: _Block) -> Items:
    return Items(*block.sent.value)


class _Block:
    """A broadcast block, told by the digest of what it holds; each Python worker builds its index once."""

    def __init__(self, sent, key: str):
        self.sent, self.key = sent, key

    def __eq__(self, other) -> bool:
        return self.key == other.key

    def __hash__(self) -> int:
        return hash(self.key)


def _chunks(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """The rows in parts of about CHUNK characters."""
    part = b["t"].str.len().to_numpy().cumsum() // CHUNK
    for _, p in b.groupby(part, sort=False):
        yield p


def found(items: DataFrame, docs: DataFrame, item_key: str = "item_id", doc_key: str = "doc_id", text: str = "text", most: int = 64_000_000) -> DataFrame:
    """Distinct (item_id, doc_id): the texts that hold passages of an item by the rule above.

    The test items are sent to all executors, at most ``most`` characters of them: a test set, not a corpus.
    """
    ask = items.where(F.col(item_key).isNotNull() & (F.length(text) > 0)).select(F.col(item_key).cast("long").alias("i"), F.col(text).alias("t")).distinct()
    size = ask.agg(F.sum(F.length("t"))).first()[0] or 0
    if size > most:
        raise ValueError(f"the test items have {size} characters; split them into sets of at most {most}")
    shared = shared_words(ask).withColumnsRenamed({"i": "i_", "t": "t_"})
    marked = ask.join(shared, (F.col("i") == F.col("i_")) & (F.md5("t") == F.col("t_")), "left").select("i", "t", "starts").collect()
    rows = sorted(((r.i, r.t, {k for s in r.starts or () for k in range(s, s + WORDS)}) for r in marked), key=lambda r: r[:2])
    base = docs.where(F.col(doc_key).isNotNull() & (F.length(text) > 0)).select(F.col(doc_key).cast("long").alias("d"), F.col(text).alias("t"))
    sc = docs.sparkSession.sparkContext
    blocks = [_Block(sc.broadcast(part), hashlib.md5(repr([*part[:2], [sorted(s) for s in part[2]]]).encode()).hexdigest()) for part in _blocks(rows)]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p in _chunks(b):
                cut, keys = [words(t) for t in p["t"]], p["d"].to_numpy()
                pairs = [(i, keys[k]) for block in blocks for i, k in _index(block).search(cut)]
                yield pd.DataFrame(pairs, columns=["item_id", "doc_id"], dtype="int64")

    return base.mapInPandas(search, "item_id long, doc_id long").distinct()

