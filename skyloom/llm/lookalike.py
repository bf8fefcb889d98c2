"""Visually identical text with different characters, brought to one form.

``plain`` undoes what hides in single characters: full-width, styled and joined letters, every kind of space, invisible
characters, the order and composition of accents. Look-alike letters of other scripts are repaired token by token: the letters
that only one script has decide the token's script, else the text's do, and the others are changed to it where the result
is a word of the corpus (one that also occurs written otherwise).

Defined cases: a NULL text stays NULL and, like an empty one, is never a case; texts of any length are handled whole;
repeated rows and equal texts form one class; rows without an id belong to no pair; an empty table gives an empty result;
further columns are kept.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyloom.common import checkpointed, free_name
from skyloom.operators.hot import hot_keys, salted

# Letters that the published tables of confusable characters give as looking like a Latin letter, as pairs, each script's
# own letters by turns with the Latin ones. Of two letters that look like the same Latin one the first is put back in its place.
CONFUSABLE = {
    "cyrillic": "аa гr еe оo рp сc уy хx ѕs іi јj һh ӏl ԁd ԛq ԝw ѡw ѵv үy АA ВB ЕE ЅS ІI ЈJ КK МM НH ОO РP СC ТT УY ХX ҮY ѴV ԌG ԚQ ԜW",
    "greek": "αa γy ιi νv οo ρp σo υu ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX",
    "armenian": "օo սu ոn հh ցg զq յj ռn ՕO ՍU ՏS",
    "cherokee": "ᎠD ᎡR ᎢT Ꭵi ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᎽY ᏀG ᏃZ ᏟC ᏢP ᏦK ᏙV ᏚS ᏞL ᏴB",
}
# Characters without a picture of their own, and the marks that make one picture of several emoji.
INVISIBLE = "\u00ad\u034f\u061c\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"
JOINER = "\u200d"
SAME_SIGN = {"\u2010": "-", "\u2011": "-", "\u00b5": "\u03bc", "\r": "\n", "\u2028": "\n", "\u2029": "\n", "\x85": "\n", "\t": " "}

TO_LATIN = {p[0]: p[1] for pairs in CONFUSABLE.values() for p in pairs.split()}
FROM_LATIN = {script: {p[1]: p[0] for p in reversed(pairs.split())} for script, pairs in CONFUSABLE.items()}
TOKEN = re.compile(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036f])*")
INVISIBLES = re.compile(f"[{INVISIBLE}]+")


class Table(dict):
    """A table for ``str.translate`` that is worked out for each character when it first comes up."""

    def __init__(self, form):
        super().__init__()
        self.form = form

    def __missing__(self, code: int) -> str | None:
        found = self[code] = self.form(chr(code))
        return found


def _one(c: str) -> str:
    """The plain form of a character, where it differs only in width, style or being joined."""
    if unicodedata.category(c) == "Zs":
        return " "
    d = unicodedata.decomposition(c)
    if d.startswith("<"):
        tag, *to = d.split()
        letters = "".join(chr(int(x, 16)) for x in to)
        if tag in ("<wide>", "<narrow>", "<font>") or tag == "<compat>" and len(letters) > 1 and letters.isalpha():
            return "".join(map(_one, letters))
    return SAME_SIGN.get(c, c)


PLAIN = Table(_one)


def _emoji(c: str) -> bool:
    return unicodedata.category(c) in ("So", "Sk") or c in "\ufe0f\u2640\u2642"


def _seen(m: re.Match) -> str:
    s, a, b = m.string, m.start(), m.end()
    joins = JOINER in m[0] and a and b < len(s) and _emoji(s[a - 1]) and _emoji(s[b])
    return JOINER if joins else ""


def plain(text: str) -> str:
    """The text without differences that nobody sees, look-alike letters apart; accents are decomposed."""
    if text.isascii():
        return text.replace("\r\n", "\n").replace("\r", "\n").replace("\t", " ")
    text = INVISIBLES.sub(_seen, text.replace("\r\n", "\n"))
    return unicodedata.normalize("NFD", text.translate(PLAIN))


@lru_cache(maxsize=4096)
def _script(c: str) -> str:
    o = ord(c)
    if o < 0x250 or 0x1E00 <= o < 0x1F00:
        return "latin"
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return "greek"
    if 0x400 <= o < 0x530:
        return "cyrillic"
    if 0x530 <= o < 0x590:
        return "armenian"
    if 0x13A0 <= o < 0x1400:
        return "cherokee"
    return "other"


def _own(letters: str) -> str | None:
    """The script of the letters that no other script of the token has alike, if they agree on one."""
    return _own_known(letters) if len(letters) < 40 else _own_known.__wrapped__(letters)


@lru_cache(maxsize=100_000)
def _own_known(letters: str) -> str | None:
    others = {s for c in letters if (s := _script(c)) in FROM_LATIN} or FROM_LATIN.keys()
    found = None
    for c in letters:
        s = _script(c)
        if c in TO_LATIN or unicodedata.combining(c) or s == "latin" and any(c in FROM_LATIN[o] for o in others):
            continue
        if s == "other" or found not in (None, s):
            return "mixed"
        found = s
    return found


def _to(token: str, script: str) -> str:
    """The token with the letters of other scripts changed to those of ``script`` that look like them."""
    back = FROM_LATIN.get(script)
    if back is None:
        return "".join(TO_LATIN.get(c, c) for c in token)
    return "".join(c if _script(c) == script else back.get(TO_LATIN.get(c, c), c) for c in token)


#: A letter of a script that has look-alikes of Latin ones: a text without any has nothing to repair.
FOREIGN = re.compile("[\u0370-\u03ff\u0400-\u058f\u13a0-\u13ff\u1f00-\u1fff]")


def repairs(text: str) -> list[tuple[int, str, str]]:
    """(place, token, repaired token) for the tokens of a plain text that another script's letters would change."""
    if not FOREIGN.search(text):
        return []
    toks = [(m.start(), m[0]) for m in TOKEN.finditer(text)]
    counts: dict[str, int] = {}
    for _, t in toks:
        if (s := _own(t)) and s != "mixed":
            counts[s] = counts.get(s, 0) + 1
    main = max(sorted(counts), key=counts.get) if counts else "latin"
    out = []
    for at, t in toks:
        script = _own(t) or main
        if script != "mixed" and (new := _to(t, script)) != t:
            out.append((at, t, new))
    return out


def repaired(text: str, words: set[str]) -> str:
    """The plain text with those repairs made whose result is among ``words``; accents composed."""
    out, at = [], 0
    for start, old, new in repairs(text):
        if new in words:
            out += [text[at:start], new]
            at = start + len(old)
    return unicodedata.normalize("NFC", "".join(out) + text[at:])


STRINGS = T.ArrayType(T.StringType())
PREPARED = T.StructType([T.StructField("plain", T.StringType()), T.StructField("old", STRINGS), T.StructField("new", STRINGS)])


def _prepared(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        if not t:
            rows.append((t, [], []))
            continue
        p = plain(t)
        r = sorted({(a, b) for _, a, b in repairs(p)})
        rows.append((unicodedata.normalize("NFC", p) if not r else None, [a for a, _ in r], [b for _, b in r]))
    return pd.DataFrame(rows, columns=["plain", "old", "new"])


def _finished(texts: pd.Series, words: pd.Series) -> pd.Series:
    return pd.Series([repaired(plain(t), set(w) if w is not None else set()) for t, w in zip(texts, words)], dtype=object)


ASCII = r"^[\x00-\x7F]*\z"


def _scanned(text: str):
    """struct(plain, old, new): the form of a text without doubtful tokens, or its tokens and what they would be repaired to. Only texts beyond ASCII go to Python."""
    simple = F.translate(F.replace(F.col(text), F.lit("\r\n"), F.lit("\n")), "\r\t", "\n ")
    none = F.array().cast("array<string>")
    other = F.pandas_udf(_prepared, PREPARED)(F.when(~F.rlike(text, F.lit(ASCII)), F.col(text)))
    return F.when(F.rlike(text, F.lit(ASCII)), F.struct(simple.alias("plain"), none.alias("old"), none.alias("new"))).otherwise(other)


WORD = r"\p{L}[\p{L}\p{M}]*"
#: Words sought in the corpus that are sent to all executors; with more the texts' words are shuffled instead, to the same result.
FEW_WORDS = 1_000_000


def _good_words(doubtful: DataFrame, texts: DataFrame) -> DataFrame:
    """(word): results of repairs that are words of the corpus: found as such in ``texts`` (_t), or under two spellings among ``doubtful`` (old, new)."""
    pairs = checkpointed(
        doubtful.select(F.explode(F.arrays_zip("old", "new")).alias("z")).select(F.col("z.new").alias("word"), F.col("z.old").alias("written")).distinct()
    )
    # as texts have them: composed or decomposed
    wanted = pairs.select("word").distinct().select(
        "word", F.explode(F.array_distinct(F.array("word", F.pandas_udf(_composed, T.StringType())("word")))).alias("w")
    )
    wanted = checkpointed(wanted)
    words = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))).alias("w"))
    if wanted.count() <= FEW_WORDS:  # sought where the texts lie; else words are made distinct before they travel
        words = words.join(F.broadcast(wanted.select("w").distinct()), "w", "left_semi")
    genuine = wanted.join(words.distinct(), "w", "left_semi").select("word", F.col("word").alias("written"))
    return pairs.unionByName(genuine).groupBy("word").agg(F.countDistinct("written").alias("n")).where(F.col("n") > 1).select("word")


def _composed(s: pd.Series) -> pd.Series:
    return pd.Series([unicodedata.normalize("NFC", x) for x in s], dtype=object)


def _repaired(doubtful: DataFrame, texts: DataFrame) -> DataFrame:
    """(digest, one_form) of the distinct doubtful texts (digest, _t, old, new)."""
    each = doubtful.groupBy("digest").agg(*(F.first(c).alias(c) for c in ("_t", "old", "new")))
    good = _good_words(each, texts)
    mine = each.select(
        "digest", F.explode(F.array_distinct("new")).alias("word")
    ).join(good, "word").groupBy("digest").agg(F.collect_set("word").alias("_words"))
    return each.select("digest", "_t").join(mine, "digest", "left").select("digest", F.pandas_udf(_finished, T.StringType())("_t", "_words").alias("one_form"))


def one_form(df: DataFrame, text: str = "text") -> DataFrame:
    """The table with the column ``one_form`` added (with underscores behind it if the name is taken).

    Texts without a doubtful token are done where they lie; only the others travel.
    """
    name, p, digest = free_name(df, "one_form"), free_name(df, "_p"), free_name(df, "_digest")
    scanned = df.withColumn(p, F.when(F.length(text) > 0, _scanned(text)))
    clear = scanned.where(F.coalesce(F.size(f"{p}.old"), F.lit(0)) <= 0).select(*df.columns, F.coalesce(f"{p}.plain", text).alias(name))
    doubtful = scanned.where(F.size(f"{p}.old") > 0)
    texts = df.where(F.length(text) > 0).select(F.col(text).alias("_t"))
    forms = _repaired(
        checkpointed(doubtful.select(F.md5(text).alias("digest"), F.col(text).alias("_t"), F.col(f"{p}.old").alias("old"), F.col(f"{p}.new").alias("new"))),
        texts
    )
    mended = doubtful.withColumn(digest, F.md5(text)).join(forms.withColumnsRenamed({"digest": digest, "one_form": name}), digest).select(*df.columns, name)
    return clear.unionByName(mended)


def _looks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(k, digest, form): of every non-empty text the digests of itself and of its form."""
    base = df.where(F.col(key).isNotNull() & (F.length(text) > 0)).select(F.col(key).alias("k"), F.col(text).alias("_t"))
    scanned = base.select("k", "_t", _scanned("_t").alias("p"))
    fair = F.size("p.old") == 0
    seen = checkpointed(
        scanned.select("k", F.md5("_t").alias("digest"), F.when(fair, F.md5("p.plain")).alias("form"), F.when(~fair, F.col("_t")).alias("_t"), "p.old", "p.new")
    )
    doubtful = seen.where(F.col("form").isNull())
    forms = _repaired(doubtful, base.select("_t")).select("digest", F.md5("one_form").alias("form"))
    return checkpointed(
        seen.where(F.col("form").isNotNull()).select("k", "digest", "form").unionByName(
            doubtful.select("k", "digest").join(forms, "digest").select("k", "digest", "form")
        )
    )


def look_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, members, spellings): of every non-empty text its class of texts that look the same, told by the least id in it,
    with the class's number of texts and of different texts. One row a text however large a class is."""
    looks = _looks(df, key, text)
    each = looks.groupBy("form", "digest").agg(F.min("k").alias("k"), F.count("*").alias("n"))  # copies first, so a large class is small
    classes = each.groupBy("form").agg(F.min("k").alias("class_id"), F.sum("n").alias("members"), F.count("*").alias("spellings"))
    left, right, keys = salted(looks, classes, ["form"], F.col("k"), hot_keys(looks, ["form"]))
    return left.join(right, keys).select(F.col("k").alias("doc_id"), "class_id", "members", "spellings").distinct()


def same_look(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id_1 < doc_id_2) of the non-empty texts that differ in their characters but have one form.

    Texts stay where they are; digests of texts and forms travel, and the doubtful texts. Pairs are made between classes of equal texts
    within one form and members join afterwards, so no pair of equal texts ever arises. A class of many spellings has as many
    pairs as there are; ``look_classes`` gives the same in one row a text.
    """
    looks = _looks(df, key, text)
    classes = looks.groupBy("form", "digest").agg(F.count("*").alias("n"))
    shared = classes.groupBy("form").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("form")
    classes = checkpointed(classes.select("form", "digest").join(shared, "form"))
    pairs = classes.select("form", F.col("digest").alias("d1")).join(
        classes.select("form", F.col("digest").alias("d2")), "form"
    ).where(F.col("d1") < F.col("d2")).select("d1", "d2")
    members = looks.select("k", "digest").join(classes.select("digest"), "digest", "left_semi").distinct()
    hot = hot_keys(members, ["digest"])
    one, two = members.select(F.col("k").alias("k1"), F.col("digest").alias("d1")), members.select(F.col("k").alias("k2"), F.col("digest").alias("d2"))
    left, right, keys = salted(one, pairs, ["d1"], F.col("k1"), hot.withColumnRenamed("digest", "d1") if hot is not None else None)
    half = left.join(right, keys).select("k1", "d2")
    left, right, keys = salted(half, two, ["d2"], F.col("k1"), hot.withColumnRenamed("digest", "d2") if hot is not None else None)
    return left.join(right, keys).where(F.col("k1") != F.col("k2")).select(
        F.least("k1", "k2").alias("doc_id_1"), F.greatest("k1", "k2").alias("doc_id_2")
    ).distinct()
